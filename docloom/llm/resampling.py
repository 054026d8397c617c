"""Importance resampling towards a target: hashed n-grams, log-ratio gains, and a draw by perturbed weights.

Features are all runs of one to three words, hashed to 10,000 buckets.  A bucket's gain is the log of its share in the target
over its share in the corpus, so a document's weight is the sum of its features' gains; the highest weights plus Gumbel noise are a
draw without replacement in proportion to them.

Long texts are cut into chunks at word boundaries.  A chunk owns the starting positions up to the next chunk's first word, and
carries the two words after that, so each feature is counted once, by the chunk where it starts; chunks are spread over all
tasks and their sums are added up by document.  Counts are sums of 10,000 numbers a task, and only the gains (10,000 integers)
go to all tasks.  Ranks come from a range partition of (score, id): a row's place in its part and the sizes of the parts before.

Edge cases: a null or empty text, and one without words, has no features and weight 0, and is not drawn; a null id is hashed as an
empty one and comes after others of its score; repeated rows count each and take ranks one after the other, in any order; empty
corpus or target tables leave all counts of theirs at 0.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.arrays import slices
from docloom.llm.common import staged

#: Words in a feature at most, buckets, least words of a document that may be drawn, percentage that is drawn, and the noise's seed.
NGRAM, BUCKETS, MIN_WORDS, PERCENT, SEED = 3, 10_000, 20, 5, "42"
#: Bytes from which a text is cut, and of a chunk.
CHUNK = 1 << 16
_WORD, _NO_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*b"0123456789", *b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", *b"abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ONES = np.uint32(0xFFFFFFFF)
#: Bytes of a word up to which its checksum is computed beside others'.
_SHORT = 64


class Crc:
    """CRC-32 of words and of runs of words, many at once.

    The register after some bytes is linear in the register before them: following it with n more bytes is a shift by n zero
    bytes, a table for each n below 256 and for each power of two from there, then an exclusive or with the bytes' own register.
    """

    def __init__(self):
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
        self.step = step
        unit = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        tables = [unit]
        for _ in range(256):
            last = tables[-1]
            tables.append((last >> np.uint32(8)) ^ step[last & 255])
        self.low = np.stack(tables[:256])
        self.high = [tables[256]]
        while len(self.high) < 32:
            self.high.append(self._through(self.high[-1], self.high[-1]))

    @staticmethod
    def _through(table: np.ndarray, x: np.ndarray) -> np.ndarray:
        return table[0][x & 255] ^ table[1][(x >> np.uint32(8)) & 255] ^ table[2][(x >> np.uint32(16)) & 255] ^ table[3][x >> np.uint32(24)]

    def shift(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = (n & 255) * 1024
        flat = self.low.ravel()
        out = flat[at + (x & 255)] ^ flat[at + 256 + ((x >> np.uint32(8)) & 255)] ^ flat[at + 512 + ((x >> np.uint32(16)) & 255)] ^ flat[at + 768 + (x >> np.uint32(24))]
        rest = n >> 8
        for b in range(int(rest.max(initial=0)).bit_length()):
            hit = np.flatnonzero((rest >> b) & 1)
            out[hit] = self._through(self.high[b], out[hit])
        return out

    def words(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The registers after each word, from zero."""
        order = np.argsort(-sizes, kind="stable")
        at, n = starts[order], sizes[order]
        long = int(np.searchsorted(-n, -_SHORT))
        found = np.zeros(len(n), np.uint32)
        for k in range(min(_SHORT, int(n[long]) if long < len(n) else 0)):
            end = int(np.searchsorted(-n, -k))
            now = found[long:end]
            found[long:end] = (now >> np.uint32(8)) ^ self.step[(now ^ raw[at[long:end] + k]) & 255]
        if long:
            ends = np.array([zlib.crc32(raw[a : a + size].tobytes()) for a, size in zip(at[:long].tolist(), n[:long].tolist())], np.uint32)
            found[:long] = ends ^ _ONES ^ self.shift(np.full(long, _ONES), n[:long])
        out = np.empty_like(found)
        out[order] = found
        return out


_crc: list[Crc] = []


class Features:
    """The features of bodies that start before each body's ``own`` bytes: per word, the buckets of its runs (-1: none)."""

    def __init__(self, bodies: list[bytes], own: list[int], ngram: int = NGRAM, buckets: int = BUCKETS):
        if not _crc:
            _crc.append(Crc())
        crc = _crc[0]
        raw = _LOWER[np.frombuffer(b"\n".join(bodies) + b"\n", np.uint8)]
        word = _IS_WORD[raw]
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        edges = np.concatenate([[0], edges]) if len(word) and word[0] else edges
        starts, ends = edges[::2], edges[1::2]
        begins = np.cumsum([0] + [len(b) + 1 for b in bodies])
        self.first = np.searchsorted(starts, begins)
        of = np.repeat(np.arange(len(bodies)), np.diff(self.first))
        self.mine = starts - begins[of] < np.array(own, np.int64)[of] if len(of) else np.zeros(0, bool)
        sizes = ends - starts
        alone = crc.words(raw, starts, sizes)
        after = alone ^ crc.shift(np.full(len(sizes), crc.step[32], np.uint32), sizes)
        run = alone ^ crc.shift(np.full(len(sizes), _ONES), sizes)
        self.buckets = []
        for k in range(ngram):
            if k:
                run = crc.shift(run[:-1], sizes[k:] + 1) ^ after[k:]
            found = np.full(len(sizes), -1, np.int64)
            found[: len(run)] = (run ^ _ONES) % np.uint32(buckets)
            if k:
                found[: len(run)][of[: len(run)] != of[k:]] = -1
            found[~self.mine] = -1
            self.buckets.append(found)

    def sums(self, per_word: np.ndarray) -> np.ndarray:
        """Sums of a number of each word, by body."""
        total = np.concatenate([[0], np.cumsum(per_word)])
        return total[self.first[1:]] - total[self.first[:-1]]


def cut(text: bytes, size: int = CHUNK, carry: int = NGRAM - 1) -> Iterator[tuple[int, bytes]]:
    """(owned bytes, body) of the chunks of a text: each starts with a word of its own and ends with ``carry`` words of the next."""
    start = 0
    while start + size < len(text):
        at = start + size
        if _WORD.match(text, at - 1):  # the word before goes on
            found = _NO_WORD.search(text, at)
            at = found.start() if found else len(text)
        found = _WORD.search(text, at)
        if not found:
            break
        end, own = found.end(), found.start() - start
        for _ in range(carry - 1):
            more = _WORD.search(text, end)
            end = more.end() if more else end
        yield own, text[start : end if carry else found.start()]
        start = found.start()
    yield len(text) - start, text[start:]


def chunks(texts: DataFrame, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Of (id, text): the short ones as (id, own, body), and the long ones as chunks (row, id, own, body), staged and dealt to all tasks."""
    body = texts.select("id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    short = body.where(F.octet_length("body") <= size).select("id", F.octet_length("body").cast("long").alias("own"), "body")
    long = body.where(F.octet_length("body") > size).select(F.monotonically_increasing_id().alias("row"), "id", "body")
    names = ["row", "no", "id", "own", "body"]
    kind = T.StructType([T.StructField("row", T.LongType()), T.StructField("no", T.LongType()), texts.schema["id"], T.StructField("own", T.LongType()), T.StructField("body", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", rows=1):
            row, own_id = batch.column("row"), batch.column("id")
            for no, (own, body) in enumerate(cut(batch.column("body")[0].as_py(), size)):
                yield pa.RecordBatch.from_arrays([row, pa.array([no], pa.int64()), own_id, pa.array([own], pa.int64()), pa.array([body], pa.binary())], names=names)

    return short, staged(long.mapInArrow(run, kind).repartition("row", "no").drop("no"), "chunks")


def bucket_counts(bodies: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of (own, body) fall in each bucket; a task sends a row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "body"):
            for found in Features(batch.column("body").to_pylist(), batch.column("own").to_pylist(), ngram, buckets).buckets:
                total += np.bincount(found[found >= 0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in bodies.select("own", "body").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log of each bucket's share in the target over that in the corpus, both with one added, rounded down."""
    size, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(bodies: DataFrame, gain: np.ndarray, keep: list[str], ngram: int = NGRAM) -> DataFrame:
    """(keep, n_words, n_features, weight) of each (own, body)."""
    added = ["n_words", "n_features", "weight"]
    kind = T.StructType([*(bodies.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        padded = np.append(gain, 0)  # of -1: no feature
        for batch in slices(batches, "body"):
            found = Features(batch.column("body").to_pylist(), batch.column("own").to_pylist(), ngram, len(gain))
            sums = [found.sums(found.mine.astype(np.int64)), found.sums(sum((b >= 0).astype(np.int64) for b in found.buckets)), found.sums(sum(padded[b] for b in found.buckets))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x, pa.int64()) for x in sums)], names=kind.names)

    return bodies.select(*keep, "own", "body").mapInArrow(run, kind)


def noise(key: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranks(rows: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """``rows`` with their rank, from 1: parts are ranges of the order, and a row's place in its part follows the parts before."""
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = staged(placed.select(*rows.columns, F.shiftrightunsigned("__at", 33).cast("int").alias("__part"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")), "ranks")
    sizes = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # a row for each part
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    return placed.withColumn("rank", F.get(F.array(*map(F.lit, before or [0])), F.col("__part")).cast("long") + F.col("__at") + 1).drop("__part", "__at")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT,
    ngram: int = NGRAM, buckets: int = BUCKETS, least: int = MIN_WORDS, seed: str = SEED, size: int = CHUNK,
) -> DataFrame:
    """(key, n_features, weight, score, rank) of each row; ranks of the ``percent`` of highest scores, null for the others."""
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    short, long = chunks(texts, size)
    goal = chunks(target.select(F.lit(0).alias("id"), F.col(target_text).alias("text")), size)
    both = lambda pair: pair[0].select("own", "body").unionByName(pair[1].select("own", "body"))
    gain = gains(bucket_counts(both((short, long)), ngram, buckets), bucket_counts(both(goal), ngram, buckets))
    added = ["n_words", "n_features", "weight"]
    whole = weigh(long, gain, ["row", "id"], ngram).groupBy("row").agg(F.first("id").alias("id"), *(F.sum(c).alias(c) for c in added)).drop("row")
    weighed = weigh(short, gain, ["id"], ngram).unionByName(whole)
    scored = staged(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("tie", F.monotonically_increasing_id()), "scores")
    able = F.col("n_words") >= least
    drawn = scored.where(able).count() * percent // 100
    placed = ranks(scored.where(able), [F.desc("score"), F.asc_nulls_last("id"), F.asc("tie")], int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return placed.unionByName(scored.where(~able), allowMissingColumns=True).select(F.col("id").alias(key), "n_features", "weight", "score", "rank")
