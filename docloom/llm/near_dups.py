"""MinHash near-duplicates: one-permutation hashing, star-shaped candidates, and exact confirmation.

A document's set holds its distinct shingles.  One permutation of the shingles' hashes is cut into bins; the least hash of
each bin is the signature, and an empty bin takes the value of the first full bin in an order of its own (optimal
densification).  Bands of the signature are buckets.  Documents with equal sets are one class, and classes meet in buckets.

1. In each bucket, the member with the largest sum of its own buckets' sizes (of equals the least) is the centre of a star;
   each edge is confirmed on the two full sets.
2. What is left are links of which one side at least is not linked with the centre.  Let D be what a set and the centre's do
   not share.  Two linked sets of which one is not linked with the centre always share elements of their Ds, and the sizes say
   how many at least (see ``near_duplicates``).  So each D is put in a fixed order, new elements first, and only elements that
   can be the first shared one of a linked pair are grouped, by centre and element.  A group's members of unlike labels
   are compared on full sets, in tasks of two bounded blocks.  Equal groups are compared once.
3. Links become components by alternating large and small stars.

Stars and differences are in proportion to the members of buckets.  Members that are near a centre but unlike each other, as
edited copies of one text are, fall into groups of few; only those that share the same rare edits meet in blocks.

A link of similarity 0.8 shares no bucket with a chance of (1 - 0.8 ** 5) ** 36, about 6e-7; no other link is lost.

Edge cases: null and empty texts have empty sets and are linked with nothing; a text with fewer words than a shingle is one
shingle; documents of equal sets are linked; rows that share an id count as one document of several texts, and each is
returned; a row with a null id is linked with nothing: its component is null and it is kept.  The id must be an integer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrays import Words, mix, slices
from docloom.llm.common import staged

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 36, 5
#: Members in one block of a bucket, and of one part of a star.
BLOCK = 256
#: Bytes of text that a task turns into arrays at once.
SLICE = 1 << 20
_M = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA0761D6478BD642F)]


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    w = Words([t.lower() for t in texts])
    h = w.hashes()
    s = h.copy()
    for k in range(1, shingle):
        s = mix(s * _M[0] + np.concatenate([h[k:], np.zeros(min(k, len(h)), np.uint64)]) + _M[1])
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        n = b - a
        if n >= shingle:
            out.append(np.unique(s[a : b - shingle + 1]))
        elif n:
            one = np.array([n], np.uint64)
            for x in h[a:b]:
                one = mix(one * _M[2] + x)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Banding:
    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(7)
        #: For each bin, the order in which it looks at other bins when empty.
        self.turn = np.argsort(rng.random((self.bins, self.bins)), axis=1).argsort(axis=1).astype(np.int32)

    def keys(self, s: np.ndarray) -> np.ndarray:
        """One bucket for each band."""
        h = mix(s ^ _M[3])
        h.sort()
        bins = ((h >> np.uint64(40)) * np.uint64(self.bins)) >> np.uint64(24)
        full, first = np.unique(bins, return_index=True)
        full = full.astype(np.int64)
        value = np.zeros(self.bins, np.uint64)
        value[full] = h[first]
        if len(full) < self.bins:
            empty = np.setdiff1d(np.arange(self.bins), full, assume_unique=True)
            value[empty] = value[full[self.turn[np.ix_(empty, full)].argmin(axis=1)]]
        table = value.reshape(self.bands, self.rows)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for k in range(self.rows):
            key = mix(key * _M[0] + table[:, k])
        return key.view(np.int64)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _told(s: np.ndarray) -> int:
    """Tells the sets of one id apart."""
    return int.from_bytes(_digest(s)[:8], "little", signed=True)


def _sketches(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, n, digest, told, keys) of every row of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        banding = Banding(bands, rows)
        for batch in slices(batches, "text", SLICE):
            sets = shingle_sets([(t or "").encode() for t in batch.column("text").to_pylist()], shingle)
            keys = [banding.keys(s).tolist() if len(s) >= 2 else None for s in sets]
            digests = [_digest(s) if len(s) else None for s in sets]
            told = [_told(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(told, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "digest", "told", "keys"])

    return docs.mapInArrow(run, "id long, n long, digest binary, told long, keys array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, told, set); of repeated rows in one slice of a partition one stays, and more of them later do no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            sets = shingle_sets([(t or "").encode() for t in batch.column("text").to_pylist()], shingle)
            once = {(i, _told(s)): s.tobytes() for i, s in zip(batch.column("id").to_pylist(), sets)}
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in once], pa.int64()), pa.array([t for _, t in once], pa.int64()), pa.array(once.values(), pa.binary())], names=["id", "told", "set"])

    return docs.mapInArrow(run, "id long, told long, set binary")


def _within(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    """Which elements of ``small`` are in ``large`` (sorted)."""
    return large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((a, b), key=len)
    if 100 * len(small) < percent * len(large):
        return False
    both = int(_within(small, large).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _deal(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (centre, head, id, told, ...) with the member's set, in parts of bounded size that each start with the centre's own set."""
    star = ["centre", "head"]
    degree = edges.groupBy(*star).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    parts = edges.join(degree, star).withColumn("part", F.pmod(F.xxhash64("id", "told"), F.col("parts")).cast("int")).drop("parts").withColumn("leads", F.lit(0))
    heads = degree.select(*star, F.col("centre").alias("id"), F.col("head").alias("told"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("leads"))
    both = parts.unionByName(heads, allowMissingColumns=True).join(sets, ["id", "told"])
    return both.repartition(*star, "part").sortWithinPartitions(*star, "part", F.desc("leads"))


def _confirm_stars(dealt: DataFrame, percent: int) -> DataFrame:
    """(centre, head, id, told, n, d, linked): the member's size, the elements that it and the centre do not share, and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = np.zeros(0, np.uint64)
        for batch in slices(batches, "set"):
            keep, n, d, linked = [], [], [], []
            for k, (leads, raw) in enumerate(zip(batch.column("leads").to_pylist(), batch.column("set").to_pylist())):
                s = np.frombuffer(raw, np.uint64)
                if leads:
                    lead = s
                    continue
                small, large = sorted((lead, s), key=len)
                both = int(_within(small, large).sum())
                keep.append(k)
                n.append(len(s))
                d.append(len(s) + len(lead) - 2 * both)
                linked.append(100 * both >= percent * (len(s) + len(lead) - both))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("centre", "head", "id", "told")), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(linked, pa.bool_())], names=["centre", "head", "id", "told", "n", "d", "linked"])

    return dealt.mapInArrow(run, "centre long, head long, id long, told long, n long, d long, linked boolean")


def _differences(dealt: DataFrame) -> DataFrame:
    """Each member's first ``reach`` elements of what it and the centre do not share, new ones first, and their positions."""
    names = ["centre", "head", "id", "told", "linked", "t", "top"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = np.zeros(0, np.uint64)
        for batch in slices(batches, "set", SLICE // 2):
            keep, found = [], [np.zeros(0, np.uint64)]
            for k, (leads, reach, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("leads", "reach", "set")))):
                s = np.frombuffer(raw, np.uint64)
                if leads:
                    lead = s
                    continue
                first = s[~_within(s, lead)][:reach]
                if len(first) < reach:
                    first = np.concatenate([first, lead[~_within(lead, s)][: reach - len(first)]])
                keep.append(np.full(len(first), k))
                found.append(first)
            at = np.concatenate([np.arange(len(x)) for x in found])
            rows = pa.array(np.concatenate([np.zeros(0, np.int64), *keep]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in names), pa.array(np.concatenate(found).view(np.int64)), pa.array(at, pa.int64())], names=[*names, "element", "at"])

    return dealt.mapInArrow(run, "centre long, head long, id long, told long, linked boolean, t long, top long, element long, at long")


def _rest_of_stars(checked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(bucket, id, told): groups of members of a star such that linked ones, not both linked with its centre, share a group.

    With p = 100 + percent and q = 100 - percent, sets of a and b elements that share all but x are linked if p x <= q (a + b).
    For Ds of sizes d and e that share o elements, x = d + e - 2 o.  With t = p d - q a for each side, that is t + t' <= 2 p o.
    A set that is not linked with a centre of c elements has t > q c, and each set has t >= - q c: so o > 0.  If the first shared element is at
    position i of one D, o <= d - i, so the other's t is at most u = p d + q a - 2 p i.  Both sides' t and u are held
    against each other, first with the star's least t, then with the group's least t and largest u.
    """
    p, q = 100 + percent, 100 - percent
    star, c = ["centre", "head"], F.col
    of = lambda f, x, on: f(F.when(on, F.col(x)))
    known, strange = c("linked"), ~c("linked")
    judged = checked.withColumn("t", p * c("d") - q * c("n")).withColumn("top", p * c("d") + q * c("n"))
    stars = judged.groupBy(*star).agg(of(F.min, "t", known).alias("tk"), of(F.min, "t", strange).alias("ts"), F.count_if(strange).alias("strangers"), F.count("*").alias("size")).where("strangers > 0 and size > 1")
    asked = judged.join(stars, star).withColumn("low", F.when(known, c("ts")).otherwise(F.least("tk", F.when(c("strangers") > 1, c("ts")))))
    asked = asked.withColumn("reach", F.least(c("d"), F.floor((c("top") - c("low")) / (2 * p)) + 1)).where("reach > 0")
    found = staged(_differences(_deal(asked.select(*star, "id", "told", "linked", "t", "top", "reach"), sets)).withColumn("u", c("top") - 2 * p * c("at")).drop("top", "at"), "differences")

    group = [*star, "element"]
    bounds = found.groupBy(*group).agg(
        of(F.min, "t", known).alias("tk"), of(F.min, "t", strange).alias("ts"), of(F.max, "u", known).alias("uk"), of(F.max, "u", strange).alias("us"),
        F.count_if(strange).alias("strangers"), F.min("id").alias("low"), F.max("id").alias("high"),
    ).where("low < high and (strangers > 1 and us >= ts or uk >= ts and us >= tk)")
    able = "if(linked, u >= ts and t <= us, strangers > 1 and u >= ts and t <= us or u >= tk and t <= uk)"
    return found.join(bounds, group).where(able).select(F.xxhash64(*group).alias("bucket"), "id", "told")


def links_within(ids: list[int], labels: list[int], sides: list[int], sets: list[np.ndarray], percent: int, across: bool) -> list[tuple[int, int]]:
    """Links that join members of different labels, no more of them than joins; ``across``: only between the two sides."""
    m = len(ids)
    flat = np.concatenate(sets)
    of = np.repeat(np.arange(m), [len(s) for s in sets])
    value, inverse, seen = np.unique(flat, return_inverse=True, return_counts=True)
    shared = seen[inverse] > 1
    column = np.cumsum(seen > 1) - 1
    of, at = of[shared], column[inverse[shared]]
    both = np.zeros((m, m), np.float32)
    width = int((seen > 1).sum())
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    for start in range(0, width, 8192):
        lo, hi = np.searchsorted(at, [start, start + 8192])
        x = np.zeros((m, min(8192, width - start)), np.float32)
        x[of[lo:hi], at[lo:hi] - start] = 1
        both += x @ x.T
    n = np.array([len(s) for s in sets], np.float64)
    ok = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    lab, side = np.array(labels), np.array(sides)
    ok &= lab[:, None] != lab[None, :]
    if across:
        ok &= side[:, None] != side[None, :]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(ok, 1))):
        p, q = find(labels[i]), find(labels[j])
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((ids[i], ids[j]))
    return out


def _compare_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) for rows (bucket, i, j, side, id, label, set) dealt by (bucket, i, j) and sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []

        def done() -> pa.RecordBatch:
            found = links_within([g[0] for g in group], [g[1] for g in group], [g[2] for g in group], [g[3] for g in group], percent, at[1] != at[2]) if len(group) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        for batch in slices(batches, "set"):
            for bucket, i, j, side, own, label, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", "side", "id", "label", "set"))):
                if at != (bucket, i, j):
                    if group:
                        yield done()
                    at, group = (bucket, i, j), []
                group.append((own, label, side, np.frombuffer(raw, np.uint64)))
        if group:
            yield done()

    return rows.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that is reachable, for every node that has a link (a, b) to another."""
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    mark = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", "m"))
        edges = staged(small.distinct(), "edges")
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (now.n, now.x) == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (now.n, now.x)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: key, n_shingles, component_id (the least key that is reachable), kept (whether that is the row's own)."""
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sketches = staged(_sketches(texts, shingle, bands, rows), "sketches")
    classes = staged(sketches.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep")), "classes")

    leaders = sketches.where("keys is not null").join(classes.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.col("id") == F.col("rep")))
    keyed = leaders.select("id", "told", F.explode("keys").alias("bucket")).distinct()
    counted = keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = staged(keyed.join(counted, "bucket"), "members")
    score = members.groupBy("id", "told").agg(F.sum("size").alias("score"))
    centres = members.join(score, ["id", "told"]).groupBy("bucket").agg(F.max(F.struct("score", (-F.col("id")).alias("id"), "told")).alias("c"))
    edges = members.join(centres, "bucket").select((-F.col("c.id")).alias("centre"), F.col("c.told").alias("head"), "id", "told").where("centre != id or head != told").distinct()

    sets = staged(_sets(texts.join(members.select("id").distinct(), "id", "left_semi"), shingle), "sets")
    checked = staged(_confirm_stars(_deal(edges, sets), percent), "stars")
    stars = checked.where("linked").select(F.col("centre").alias("a"), F.col("id").alias("b"))

    once = stars.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up"))
    twice = once.join(once.select(F.col("id").alias("up"), F.col("up").alias("top")), "up", "left").select("id", F.coalesce("top", "up").alias("label"))
    rest = _rest_of_stars(checked, sets, percent)
    labelled = staged(rest.join(twice, "id", "left").withColumn("label", F.coalesce("label", "id")), "rest")
    group = [F.count("*").alias("size"), F.bit_xor(F.xxhash64("id", "told")).alias("x"), F.sum(F.hash("id", "told").cast("long")).alias("y"), F.min("label").alias("low"), F.max("label").alias("high")]
    mixed = labelled.groupBy("bucket").agg(*group).where("low != high").groupBy("size", "x", "y", "low", "high").agg(F.min("bucket").alias("bucket"))
    mixed = mixed.select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    blocks = labelled.join(mixed, "bucket").withColumn("side", F.pmod(F.hash("id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = blocks.select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "id", "told", "label")
    more = _compare_blocks(tasks.join(sets, ["id", "told"]).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j"), percent)

    roots = components(stars.unionByName(more))
    found = classes.join(roots, classes["rep"] == roots["node"], "left").select("digest", F.coalesce("root", "rep").alias("component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return sketches.select("id", "n", "digest").join(found, "digest", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )
