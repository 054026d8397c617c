"""Document fingerprints: SimHash over weighted word pairs, and an exact search within a Hamming radius.

A term is a word with the word after it; each occurrence votes (so a term weighs its count) with +1 or -1 on every bit of
its 128-bit hash, and the signs of the sums are the fingerprint.  Two 32-bit counters share a long, so a text's votes are 64
sums that are aggregated where its words are.  The search cuts fingerprints into blocks, about one for each three bits of the
radius: two within the radius differ by at most two bits in at least one of them, so one table for each block, asked for the
query's bits with every such set of bits flipped, finds all; the distance confirms.  Built-in functions only.

Edge cases: null and empty texts have a fingerprint of zeros; a text of one word is one term; texts that are equal have equal
fingerprints; repeated rows are all returned, and several texts may share an id.  A row with a null id has a fingerprint but no
next document: its edited text and both likenesses are null.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import staged, words

BITS = 128
#: Of pairs of texts with a 5-word Jaccard of 0.8 and over, the README has the share that lies within.
RADIUS = 16
#: One bit at the foot of each half of a long: two counters of 32 bits.
_PAIR = 0x0000000100000001
_HALF = 0xFFFFFFFF


def fingerprint_rows(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, hi, lo, copies): the fingerprint of each distinct ``keys``, which must tell texts apart, and its number of rows."""
    tokens = texts.select(*keys, words(F.col(text)).alias("words"))
    each = tokens.select(*keys, "words", F.posexplode("words").alias("pos", "word"))
    hashed = each.select(*keys, "pos", (F.col("word") != "").alias("votes"), F.xxhash64("word", F.get("words", F.col("pos") + 1)).alias("h1")).withColumn("h2", F.xxhash64("h1"))
    vote = lambda h, i: F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_PAIR))
    sums = [F.sum(vote(h, i)).alias(f"{h}_{i}") for h in ("h1", "h2") for i in range(32)]
    voted = hashed.groupBy(*keys).agg(F.sum((F.col("pos") == 0).cast("int")).alias("copies"), F.sum(F.col("votes").cast("int")).alias("terms"), *sums)

    def side(h: str) -> Column:
        low = [F.when(F.col(f"{h}_{i}").bitwiseAND(F.lit(_HALF)) * 2 > F.col("terms"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(32)]
        high = [F.when(F.shiftrightunsigned(F.col(f"{h}_{i}"), 32) * 2 > F.col("terms"), F.lit((1 << (i + 32)) - (1 << 64 if i == 31 else 0))).otherwise(F.lit(0)).cast("long") for i in range(32)]
        out = low[0]
        for bit in low[1:] + high:
            out = out.bitwiseOR(bit)
        return F.when(F.col("terms") == 0, F.lit(0)).otherwise(out).cast("long")

    return voted.select(*keys, side("h1").alias("hi"), side("h2").alias("lo"), "copies")


def as_hex(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(hi1: Column, lo1: Column, hi2: Column, lo2: Column) -> Column:
    return F.bit_count(hi1.bitwiseXOR(hi2)) + F.bit_count(lo1.bitwiseXOR(lo2))


def likeness(*sides: Column) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1 - distance(*sides) / F.lit(float(BITS))


def _blocks(n: int) -> list[tuple[int, int]]:
    """(first bit, bits) of ``n`` blocks; no block crosses from lo to hi."""
    low = (n + 1) // 2
    out = []
    for start, count in ((0, low), (64, n - low)):
        edges = [64 * i // count for i in range(count + 1)]
        out += [(start + a, b - a) for a, b in zip(edges, edges[1:])]
    return out


def _bits(hi: str, lo: str, block: tuple[int, int]) -> Column:
    start, width = block
    return F.shiftrightunsigned(F.col(hi if start >= 64 else lo), start % 64).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def _reach(radius: int, n: int) -> list[int]:
    """Bits that may differ in each of ``n`` blocks: two fingerprints within ``radius`` are as near as that in one of them."""
    each, rest = divmod(radius, n)
    return [each] * (rest + 1) + [each - 1] * (n - rest - 1)


def within_radius(queries: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(q_hi, q_lo, hi, lo, copies, distance) for all distinct fingerprints of ``index`` (hi, lo, copies) near one of ``queries`` (hi, lo).

    A pair that meets in several tables is kept in the first one only.
    """
    blocks = _blocks(max(2, radius // 3 + 1))
    reach = _reach(radius, len(blocks))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    flips = [(t, signed(sum(1 << b for b in bits))) for t, (_, width) in enumerate(blocks) for k in range(reach[t] + 1) for bits in combinations(range(width), k)]
    spark = queries.sparkSession
    flipped = spark.sql(f"select * from values {', '.join(f'({t}, {mask})' for t, mask in flips)} as flips(q_table, mask)").select("q_table", F.col("mask").cast("long").alias("mask"))
    part = lambda hi, lo, at: F.get(F.array(*(_bits(hi, lo, b) for b in blocks)), F.col(at))

    # So many parts that a task's queries with all their flips stay few; AQE would join them into one.
    asked = queries.select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "q_hi", "q_lo").distinct()
    left = asked.join(F.broadcast(flipped)).select("q_hi", "q_lo", "q_table", part("q_hi", "q_lo", "q_table").bitwiseXOR(F.col("mask")).alias("q_part"))
    index = index.groupBy("hi", "lo").agg(F.sum("copies").alias("copies"))
    right = index.withColumn("table", F.explode(F.array(*(F.lit(t) for t in range(len(blocks)))))).withColumn("part", part("hi", "lo", "table"))
    first = F.coalesce(*(F.when(F.bit_count(_bits("q_hi", "q_lo", b).bitwiseXOR(_bits("hi", "lo", b))) <= reach[t], F.lit(t)) for t, b in enumerate(blocks)))
    apart = distance(F.col("q_hi"), F.col("q_lo"), F.col("hi"), F.col("lo"))
    met = left.join(right, (F.col("q_table") == F.col("table")) & (F.col("q_part") == F.col("part")) & (apart <= radius) & (first == F.col("table")))
    return met.select("q_hi", "q_lo", "hi", "lo", "copies", apart.alias("distance"))


def next_ids(docs: DataFrame, key: str, need: Column, parts: int) -> DataFrame:
    """(key, need, next) by ascending key, the first after the last; keys and lengths only, dealt by ranges of the key."""
    light = docs.groupBy(key).agg(F.max(need).alias("need"))
    ranged = staged(light.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id()), "order")
    # One row for each range, so the window over them is as small as the number of ranges.
    heads = ranged.groupBy("part").agg(F.min(key).alias("head"))
    after = heads.select("part", F.lead("head").over(W.orderBy("head")).alias("after"), F.min("head").over(W.partitionBy()).alias("first"))
    inside = ranged.withColumn("inside", F.lead(key).over(W.partitionBy("part").orderBy(key)))
    return inside.join(F.broadcast(after), "part").select(key, "need", F.coalesce("inside", "after", "first").alias("next"))


def fingerprints_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Per row: key, n_chars, hi, lo of the text, edited_sha256, edited_hi, edited_lo, next (the key of the next document).

    The edited text has the last half of the text, rounded down, replaced by as much of the next document's start.  Rows that
    share a key share a next document; a next key of several texts stands for the least of their starts.
    """
    parts = parts or max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    whole = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = whole.where("key is not null")
    half = lambda c: (F.length(c) / 2).cast("int")
    order = staged(next_ids(docs, "key", half("text"), parts), "next")
    starts = docs.join(order.select(F.col("key").alias("before"), F.col("next").alias("key"), "need"), "key").select(F.col("before").alias("key"), F.expr("substring(text, 1, need)").alias("start"))
    starts = starts.groupBy("key").agg(F.min("start").alias("start"))
    both = docs.join(starts, "key").select("key", "text", F.length("text").alias("n_chars"), F.expr("concat(substring(text, 1, length(text) - cast(length(text) / 2 as int)), substring(start, 1, cast(length(text) / 2 as int)))").alias("edited"))
    told = both.select("key", "n_chars", F.xxhash64("text").alias("told"), F.unhex(F.sha2("edited", 256)).alias("sha"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))).alias("x"))
    prints = fingerprint_rows(told.select("key", "n_chars", "told", "sha", F.col("x.which").alias("which"), F.col("x.body").alias("body")), ["key", "n_chars", "told", "sha", "which"], "body")
    pick = lambda which, c: F.max(F.when(F.col("which") == which, F.col(c))).alias(("edited_" if which else "") + c)
    wide = prints.groupBy("key", "n_chars", "told", "sha").agg(pick(0, "hi"), pick(0, "lo"), pick(1, "hi"), pick(1, "lo"), F.max("copies").alias("copies"))
    rows = wide.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    rows = rows.join(order.select("key", "next"), "key")
    lone = whole.where("key is null").select("key", F.length("text").alias("n_chars"), F.xxhash64("text").alias("told"), "text")
    lone = fingerprint_rows(lone, ["key", "n_chars", "told"], "text").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    rows = rows.unionByName(lone, allowMissingColumns=True)
    return rows.select(F.col("key").alias(key), F.col("n_chars").cast("long").alias("n_chars"), "hi", "lo", F.lower(F.hex("sha")).alias("edited_sha256"), "edited_hi", "edited_lo", "next")


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, every: int = 50) -> DataFrame:
    """Fingerprints, likeness to the edited text's and the next document's, and for keys divisible by ``every`` the number of
    rows within ``radius`` of the fingerprint, the row itself left out (null for the others)."""
    prints = staged(fingerprints_with_edits(docs, key, text), "prints")
    nexts = prints.groupBy(key).agg(F.min(F.struct("hi", "lo")).alias("n")).select(F.col(key).alias("next"), F.col("n.hi").alias("next_hi"), F.col("n.lo").alias("next_lo"))
    asks = prints.where(F.col(key) % every == 0)
    near = within_radius(asks, prints.select("hi", "lo", F.lit(1).alias("copies")), radius).groupBy("q_hi", "q_lo").agg((F.sum("copies") - 1).alias("n_near"))
    joined = prints.join(nexts, "next", "left").join(near.hint("merge"), (F.col(key) % every == 0) & (F.col("hi") == F.col("q_hi")) & (F.col("lo") == F.col("q_lo")), "left")
    c = F.col
    return joined.select(
        key, "n_chars", "edited_sha256", as_hex(c("hi"), c("lo")).alias("fingerprint"), as_hex(c("edited_hi"), c("edited_lo")).alias("edited_fingerprint"),
        likeness(c("hi"), c("lo"), c("edited_hi"), c("edited_lo")).alias("near_edited"), likeness(c("hi"), c("lo"), c("next_hi"), c("next_lo")).alias("near_next"), "n_near",
    )
