"""The queries op1 to op10 and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import byte_bpe, filter_audit, fingerprints, lattice, near_dups, ngram_join, packing, quality, resampling, secrets, textstats, toxicity, url_filters
from docloom.llm.common import table
from docloom.llm.learning import remainder

#: The rules of op1 (host, path, verdict).
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    rules = spark.sql(f"select * from values {values} as rules(host, path, verdict)")
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), rules)


OP1_SQL = r"""
with p as (
  select page_id,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') as h,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
q as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from p),
r as (select page_id, host, path, case
  when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/7') then 'example.com/en/7'
  when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/de/8') then 'example.net/de/8'
  when (host = 'com' or host like '%.com') and starts_with(path, '/en/') then 'com/en/'
  when (host = 'net' or host like '%.net') and starts_with(path, '/de/') then 'net/de/'
  when (host = 'org' or host like '%.org') and starts_with(path, '/es/') then 'org/es/' end as rule from q)
select page_id, host, path, rule, case when rule in ('com/en/', 'net/de/', 'org/es/') then 'block' else 'allow' end as verdict from r
"""


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_with_ledger(table(spark, sf_dir, "documents"), secrets.ledger_path(spark))
    base = [r.kind for r in secrets.BASE_RULES]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in base), F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder("doc_id", 5) == 0)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = textstats.judge_documents(table(spark, sf_dir, "documents"), keep=["doc_id"], clean=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, pattern)
    digested = encoded.select("doc_id", byte_bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    decoded = byte_bpe.decode_documents(digested, ranks, pattern, keep=["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_documents(table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2, tokenizer_path("piece_bpe_32k.model"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder("doc_id", 4) == 2)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
with recursive d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
m as (select doc_id, part,
    (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
    + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask from d),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
h as (select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from m left join l using (doc_id) group by part, mask),
f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as x(f, bit)),
o as (select '' as filter_order union all select filter_order || f from o, f where not contains(filter_order, f)),
s as (select filter_order, step, bit, coalesce((select sum(b.bit) from f b where contains(left(filter_order, step - 1), b.f)), 0)::int as before
  from o, range(1, 6) as r(step), f where length(filter_order) = 5 and f = substr(filter_order, step, 1))
select part, filter_order, step::int as step,
  coalesce(sum(n) filter (mask & (before | bit) = 0), 0)::bigint as kept,
  coalesce(sum(n) filter (mask & bit > 0 and mask & before = 0), 0)::bigint as removed,
  coalesce(sum(n) filter (mask & bit > 0 and mask & before > 0), 0)::bigint as redundant,
  coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (mask & bit > 0 and mask & before = 0), 0)::bigint as good_lost,
  coalesce(sum(toxic) filter (mask & bit > 0 and mask & before = 0), 0)::bigint as toxic_lost,
  coalesce(sum(n * (120 // greatest(1, bit_count(mask)))) filter (mask & bit > 0), 0)::bigint as shapley
from h, s group by part, filter_order, step
"""


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_sets(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
m as (select doc_id, n, shingle from s join n using (doc_id)),
l as (select a.doc_id as a, b.doc_id as b from m a join m b on a.shingle = b.shingle and a.doc_id != b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(doc_id, reached) as (select doc_id, doc_id from documents union select r.doc_id, l.b from r join l on l.a = r.reached)
select r.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(reached) as component_id from r left join n on n.doc_id = r.doc_id group by r.doc_id
"""


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_fingerprints": op2_fingerprints,
    "op3_near_dups": op3_near_dups,
    "op4_secrets": op4_secrets,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_quality_rules": op7_quality_rules,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": op11_filter_audit,
    "op12_ngram_join": op12_ngram_join,
    "op13_resampling": op13_resampling,
}
ORACLES = {"op1_url_filters": OP1_SQL, "op11_filter_audit": OP11_SQL, "op12_ngram_join": OP12_SQL}
