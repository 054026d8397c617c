"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by its SHA-256.  Only pairs of blob and rule version that the ledger has not seen are
scanned, each blob once however many paths hold it, and findings are joined back to all paths.  Built-in functions only: a
text is split at a rule's matches, and running lengths of parts and matches give the offsets in code points.

The ledger is a Parquet table in the shared folder, by rule version and by whether a blob has findings.  A run appends what it
has scanned and reads the findings from there, so a second run over the same texts scans nothing.  A blob that two runs
appended at once counts once.  Texts are dealt by blob and key, and paths of one blob over ``SALTS`` tasks, so that a blob
that is everywhere lands in no single task.

Edge cases: a null text is an empty blob; a blob without findings is in the ledger with no spans; repeated rows, several
texts under one id and rows with a null id are all returned, each with its own blob's findings; no rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import shared_dir


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates left to right; those whose ``group`` has under ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules.  For the last two, runs long enough are what is left of all runs after short ones are dropped.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: A private key, PEM or PGP, goes from its BEGIN line to the next END line.  Where another BEGIN or END line or none follows, it
#: goes to the end of what is still key: headers, lines of base64 characters only, and runs of at least 20 of them.  All loops
#: are possessive, so the matcher neither recurses over a body nor reads it again for each BEGIN.
_LABEL = r"[A-Z0-9 .]*PRIVATE KEY(?: BLOCK)?-----"
_TO_END = r"[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END " + _LABEL
_GAP, _BASE64 = r"""[\s>|"'+,;#*\\]""", r"[A-Za-z0-9+/=\\]"
_HEADER = r"(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):[^\r\n]*+"
_WHOLE_LINE = rf"""(?<=[\r\n]{_GAP}{{0,40}}){_BASE64}++(?=[\x20\t"'+,;]*+(?:[\r\n]|\z))"""
_NO_END = rf"(?:{_GAP}*+(?:{_HEADER}|{_BASE64}{{20,}}+|{_WHOLE_LINE}))*+"
#: Formats with a fixed mark, so that plain prose gives none.
MORE_RULES = (
    Rule("private_key", rf"-----BEGIN {_LABEL}(?:{_TO_END}|{_NO_END})"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_login", r"://[A-Za-z0-9._~-]*+:[^\s:@/]{3,}+@"),
)
RULE_VERSION = "1.2"
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
LEDGER = f"blob string, spans {SPANS}, rule_version string, found boolean"
#: The session setting that names the folder of the ledger.
LEDGER_SETTING = "spark.docloom.secrets.ledger"
#: Tasks over which the paths of one blob are dealt.
SALTS = 16


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's matches in ``text`` as structs (start, rank, end, kind), end exclusive."""
    hits = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(rule.group + 1))
    parts = F.split(text, rule.pattern, -1)
    lengths = F.transform(F.arrays_zip(hits.alias("hit"), F.slice(parts, 1, F.size(hits)).alias("part"), values.alias("value")), lambda x: F.struct(F.length(x["part"]).alias("before"), F.length(x["hit"]).alias("long"), F.length(x["value"]).alias("value")))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    folded = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["before"] + x["long"]).alias("at"),
            F.when(x["value"] >= rule.least, F.concat(acc["out"], F.array(F.struct((acc["at"] + x["before"]).alias("start"), F.lit(rank).alias("rank"), (acc["at"] + x["before"] + x["long"]).alias("end"), F.lit(rule.kind).alias("kind"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.rlike(text, F.lit(rule.pattern)), folded).otherwise(none)


def find_spans(text: Column, rules: tuple[Rule, ...]) -> Column:
    """All rules' matches, by start, then by the rules' order."""
    return F.array_sort(F.concat(*(_spans(text, r, i) for i, r in enumerate(rules))))


def blobs_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, blob) of every version, without the texts."""
    return docs.select(F.col(key), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"))


def ledger_path(spark: SparkSession) -> str:
    """The folder of the session's ledger; where none is set, a new one in the shared folder, so that such a run scans all."""
    return spark.conf.get(LEDGER_SETTING, None) or f"{shared_dir(spark)}/docloom/ledger-{uuid.uuid4().hex}"


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored ledger, or None where there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, version: str = RULE_VERSION, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ledger entries (blob, rule_version, spans) for the blobs of ``docs`` that ``ledger`` lacks under this version."""
    versions = docs.select(F.col(key).alias("at"), F.coalesce(F.col(text), F.lit("")).alias("body")).withColumn("blob", F.sha2("body", 256))
    first = versions.groupBy("blob").agg(F.min("at").alias("first"))
    if ledger is not None:
        first = first.join(ledger.where(F.col("rule_version") == version).select("blob").distinct(), "blob", "left_anti")
    unseen = versions.join(first.hint("shuffle_hash"), (versions["blob"] == first["blob"]) & versions["at"].eqNullSafe(first["first"]), "left_semi")
    found = unseen.select("blob", F.lit(version).alias("rule_version"), find_spans(F.col("body"), rules).alias("spans"))
    return found.dropDuplicates(["blob"])


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, version: str = RULE_VERSION, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings per row of ``docs``: key, blob, spans; new ledger entries to append to the ledger)."""
    new = scan_unseen(docs, ledger, rules, version, key, text)
    known = new.where(F.size("spans") > 0).select("blob", "spans")
    if ledger is not None:
        known = known.unionByName(ledger.where((F.col("rule_version") == version) & (F.size("spans") > 0)).select("blob", "spans"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return _to_paths(blobs_of(docs, key, text), key, known).select(key, "blob", F.coalesce("spans", none).alias("spans")), new


def _to_paths(paths: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """``paths`` (with key and blob) and the spans of ``known`` (blob, spans), null where it has none."""
    spread = known.dropDuplicates(["blob"]).select(F.col("blob").alias("__blob"), "spans", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    return paths.join(spread, (F.col("blob") == F.col("__blob")) & (F.pmod(F.xxhash64(key), F.lit(SALTS)) == F.col("__salt")), "left").drop("__blob", "__salt")


def update_ledger(docs: DataFrame, path: str, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, version: str = RULE_VERSION, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scan what the ledger at ``path`` lacks, append it there, and return the stored (blob, spans) that have findings."""
    spark = docs.sparkSession
    new = scan_unseen(docs, read_ledger(spark, path), rules, version, key, text)
    new.withColumn("found", F.size("spans") > 0).write.mode("append").partitionBy("rule_version", "found").parquet(path)
    # Read by the folders of its version and of findings, so Spark knows its size and sends it to all tasks only where that is small.
    stored = read_ledger(spark, path)
    return spark.createDataFrame([], LEDGER).select("blob", "spans") if stored is None else stored.where((F.col("rule_version") == version) & F.col("found")).select("blob", "spans")


def scan_with_ledger(docs: DataFrame, path: str, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, version: str = RULE_VERSION, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, blob, spans) per row of ``docs``, scanning only blobs that the ledger at ``path`` lacks under this version."""
    known = update_ledger(docs, path, rules, version, key, text)
    return _to_paths(blobs_of(docs, key, text), key, known).select(key, "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with its spans, overlapping ones as one, replaced by ``mark``."""
    state = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))).alias("out"),
            )
        ),
    )
    return F.when(F.size(spans) > 0, F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))).otherwise(text)


def redact_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the spans of their blobs, by the ledger at ``path``, replaced by ``mark``; texts without findings stay as they are."""
    known = update_ledger(docs, path or ledger_path(docs.sparkSession), key=key, text=text)
    spread = known.dropDuplicates(["blob"]).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    own = docs.withColumn("__own", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).withColumn("__at", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    marked = own.join(spread, (F.col("__own") == F.col("__blob")) & (F.col("__at") == F.col("__salt")), "left")
    return marked.select(*(F.when(F.col("__spans").isNull(), F.col(text)).otherwise(redact(F.col(text), F.col("__spans"), mark)).alias(text) if c == text else F.col(c) for c in docs.columns))
