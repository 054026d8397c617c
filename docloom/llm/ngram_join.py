"""Exact join of n-gram sets by Jaccard similarity, with prefix trees.

All shingles have one order: by how often their bucket of 2^20 counters occurs, rare ones first, then by hash.  Counts are over all
documents; whatever they are, the order is the same for all sets, so they bear on speed alone.

1. Equal sets are one class.  Two linked sets share one of their first n - ceil(n * percent / 100) + 1 elements, so classes
   are grouped by those elements and by size (a size meets its own range and the next one).  A first shared element at a late place leaves
   too few for a link with large sets: members that no other's size and place allow go, and so do groups that equal another's.
2. Members' parities (for each of about n / 2 hash buckets, whether a set has an odd number of elements there) differ in no more
   places than their sets do.  So a member whose parity is too far from all others' goes, and sets are made for the rest alone.
3. In a group, sets become paths of a trie, from the group's element on.  Each set walks down it; sets below a node
   share the overlap so far.  A branch is cut where the overlap and the lesser of what both sides have left can't
   reach what the smallest set below needs, or where all sets below are known to be linked with the one that walks.
   A pair is met in the group of its first shared element, so it is not walked again in others.
4. Groups of more than a block are joined within blocks first.  Of what remains, members of the label that most of
   a group has need no comparison with each other, only with the others, block by block.
5. Links become components; a task returns no more links than join its members.

No link is lost: all steps are bounds, none a sketch.  A dense group in which no two are linked costs all pairs of its
blocks in time, in tasks of bounded memory.

Edge cases: null and empty texts have empty sets and are linked with nothing; a text of fewer words than a shingle is one shingle;
rows that share an id count as one document of several texts, and each is returned; a row with a null id is linked with
nothing: its component is null.  The id must be an integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.arrays import slices
from docloom.llm.common import staged
from docloom.llm.near_dups import SLICE, _digest, components, shingle_sets

SHINGLE, PERCENT = 3, 90
#: Members and elements in a block of a group, and sets that walk down a trie together.
BLOCK, BLOCK_ELEMENTS, WALKERS = 256, 1 << 21, 32
#: Members and bytes in a block of parities.
SIFTED, SIFTED_BYTES = 4096, 1 << 24
#: Bits of the counters' number, and of the filter that finds the rows whose sets are wanted.
COUNTER_BITS, FILTER_BITS = 20, 22
#: Counters in a row.
CHUNK = 4096
#: Cells of a table of sets by elements.
_CELLS = 1 << 23


def _sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """A row (id, n, digest) for each document and (chunk, counts) for each part of a task's counters."""
    names = ["id", "n", "digest", "chunk", "counts"]
    counted = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int32)
        for batch in slices(batches, "text", SLICE):
            sets = shingle_sets([(t or "").encode() for t in batch.column("text").to_pylist()], shingle)
            if sets:
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(total)).astype(np.int32)
            k = len(sets)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, counted)], names=names)
        if total.any():
            parts = len(total) // CHUNK
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(total) + 1, CHUNK, dtype=np.int32)), pa.array(total))
            yield pa.RecordBatch.from_arrays([pa.nulls(parts, pa.int64()), pa.nulls(parts, pa.int64()), pa.nulls(parts, pa.binary()), pa.array(np.arange(parts, dtype=np.int32)), lists], names=names)

    return texts.mapInArrow(run, "id long, n long, digest binary, chunk int, counts array<int>")


def counter_levels(counts: DataFrame) -> np.ndarray:
    """The logs of the counters (chunk, counts), in quarters: one byte for each, however large the corpus."""
    each = counts.repartition("chunk").select("chunk", F.posexplode("counts").alias("pos", "c"))
    found = each.groupBy("chunk", "pos").agg(F.sum("c").alias("c")).toArrow()
    total = np.zeros(1 << COUNTER_BITS, np.int64)
    total[np.asarray(found.column("chunk")).astype(np.int64) * CHUNK + np.asarray(found.column("pos"))] = np.asarray(found.column("c"))
    return np.minimum(255, 4 * np.log2(1 + total)).astype(np.uint8)


def ordered(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A set's elements as numbers whose order is the one of all sets: level first, then 56 bits of the hash."""
    level = levels[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)].astype(np.uint64)
    return np.sort((level << np.uint64(56)) | (s >> np.uint64(8)))


def _prefixes(texts: DataFrame, shingle: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(node, digest, rep, n, prefix): each class's number, least id, and first elements, one of which every linked set has among its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            sets = shingle_sets([(t or "").encode() for t in batch.column("text").to_pylist()], shingle)
            first = [ordered(s, levels)[: len(s) + percent * len(s) // -100 + 1].view(np.int64).tolist() if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), pa.array(first, pa.list_(pa.int64())), pa.array([parity(s) for s in sets], pa.binary())], names=["id", "n", "digest", "prefix", "parity"])

    found = texts.where("id is not null").mapInArrow(run, "id long, n long, digest binary, prefix array<long>, parity binary").where("n > 0")
    once = found.groupBy("digest").agg(F.min("id").alias("rep"), F.first(F.struct("n", "prefix", "parity")).alias("x"))
    return once.select(F.monotonically_increasing_id().alias("node"), "digest", "rep", F.col("x.n").cast("int").alias("n"), "x.prefix", "x.parity")


def parity(s: np.ndarray) -> bytes:
    """One bit for each of a power of two of buckets, at least half as many as elements: whether their number there is odd."""
    bits = 64
    while 2 * bits < len(s):
        bits *= 2
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def near_parities(left: list[bytes], right: list[bytes], n_left: np.ndarray, n_right: np.ndarray, ok: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs that are ``ok`` can be linked, by their parities folded to the least size of all."""
    width = min(map(len, left + right)) // 8

    def folded(x: bytes) -> np.ndarray:
        return np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width), axis=0)

    a, b = np.stack([folded(x) for x in left]), np.stack([folded(x) for x in right])
    out = np.zeros(ok.shape, bool)
    for k in range(len(a)):
        at = np.flatnonzero(ok[k])
        apart = np.bitwise_count(a[k] ^ b[at]).sum(axis=1, dtype=np.int64)
        out[k, at] = (100 + percent) * apart <= (100 - percent) * (n_left[k] + n_right[at])
    return out


def _sift(members: DataFrame, percent: int) -> DataFrame:
    """(element, z, node) of the members (element, z, node, n, own, parity) that can be linked with another of their group."""
    key, group = ["element", "z", "i", "j"], ["element", "z"]
    names = [*key, "side", "node", "n", "own", "parity"]
    sizes = members.groupBy(*group).agg(F.greatest(F.ceil(F.count("*") / SIFTED), F.ceil(F.sum(F.octet_length("parity")) / SIFTED_BYTES)).cast("int").alias("parts"))
    dealt = members.join(sizes, group).withColumn("b", F.pmod(F.hash("node"), F.col("parts"))).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(*group, F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") > F.col("o")).cast("int").alias("side"), "node", "n", "own", "parity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def done() -> pa.RecordBatch:
            side, node, n, own, bits = (list(x) for x in zip(*rows))
            sides, n, own = np.array(side), np.array(n), np.array(own)
            low = np.flatnonzero(sides == 0)
            high = low if at[2] == at[3] else np.flatnonzero(sides == 1)
            found: set[int] = set()
            if len(low) and len(high):
                ok = (own[low][:, None] | own[high][None, :]) & (100 * np.minimum.outer(n[low], n[high]) >= percent * np.maximum.outer(n[low], n[high]))
                if at[2] == at[3]:
                    np.fill_diagonal(ok, False)
                near = near_parities([bits[k] for k in low], [bits[k] for k in high], n[low], n[high], ok, percent)
                found = {node[k] for k in [*low[near.any(axis=1)], *high[near.any(axis=0)]]}
            k = len(found)
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * k, pa.int64()), pa.array([at[1]] * k, pa.int64()), pa.array(sorted(found), pa.int64())], names=["element", "z", "node"])

        for batch in batches:
            for *k, side, node, n, own, bits in zip(*(batch.column(c).to_pylist() for c in names)):
                if at != k:
                    if len(rows) > 1:
                        yield done()
                    at, rows = k, []
                rows.append((side, node, n, own, bits))
        if len(rows) > 1:
            yield done()

    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "element long, z long, node long").distinct()


def _groups(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(members, groups) by (element, z): members have node, n, pos and own (of the group's own range of sizes, not the one below it)."""
    c, group = F.col, ["element", "z"]
    entries = classes.select("node", "n", F.posexplode("prefix").alias("pos", "element"))
    shared = entries.withColumn("size", F.count("*").over(W.partitionBy("element"))).where("size > 1").drop("size")
    # The largest set that a first shared element at this place allows; ranges are a little wider than the greatest ratio of linked sizes.
    up = F.floor((100 * c("n") - (100 + percent) * c("pos")) / percent)
    z = F.floor(F.log(c("n")) / float(np.log(102 / percent)))
    met = shared.withColumn("up", up).withColumn("low", F.ceil(percent * c("n") / 100)).withColumn("own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("z", z + F.when(c("own"), 0).otherwise(1))
    whole, by_size = W.partitionBy(*group), W.partitionBy(*group).orderBy("n", "node")
    owner = lambda x: F.when(c("own"), c(x))
    bounds = {
        "owners": F.count_if("own").over(whole), "n_min": F.min("n").over(whole), "own_min": F.min(owner("n")).over(whole), "up_max": F.max("up").over(whole), "own_up": F.max(owner("up")).over(whole),
        "before": F.lag("n").over(by_size), "after": F.lead("n").over(by_size),
    }
    near = "coalesce(before >= low, false) or coalesce(after <= up, false)"
    able = f"owners > 0 and ({near}) and if(own, up >= n_min and n <= up_max, up >= own_min and n <= own_up)"
    left = staged(met.withColumns(bounds).where(able).select(*group, "node", "n", "pos", "own"), "members")
    # Of equal groups the one of the element that is first in all its members stays.
    sums = left.groupBy(*group).agg(
        F.count("*").alias("size"), F.sum("n").alias("elements"), F.count_if("own").alias("owners"), F.bit_xor(F.xxhash64("node", "own")).alias("x"), F.sum(F.hash("node", "own").cast("long")).alias("y"), F.sum("pos").alias("place"),
    ).where("size > 1 and owners > 0")
    once = sums.groupBy("z", "size", "elements", "owners", "x", "y").agg(F.min(F.struct("place", "element")).alias("least")).select("z", "least.element", "size", "elements")
    return left, once


def _wanted(reps: DataFrame) -> np.ndarray:
    """A filter of 2^22 bits that has the ids of ``reps``; where it is full, more sets are made than are wanted, and no fewer."""
    at = F.pmod(F.xxhash64("rep"), F.lit(1 << FILTER_BITS)) + 1  # Spark's bitmaps count from 1
    parts = reps.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in parts:
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return np.unpackbits(out, bitorder="little").astype(bool)


def _sets(texts: DataFrame, wanted: DataFrame, shingle: int, levels: np.ndarray) -> DataFrame:
    """(digest, codes): the ordered set of each class of ``wanted`` (rep, digest), and of few others."""
    bits = _wanted(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            keep = np.flatnonzero(bits[np.asarray(whole.column("at"))])
            for batch in slices([whole.take(pa.array(keep))], "text", SLICE):
                sets = shingle_sets([(t or "").encode() for t in batch.column("text").to_pylist()], shingle)
                once = {(i, _digest(s)): ordered(s, levels).tobytes() for i, s in zip(batch.column("id").to_pylist(), sets) if len(s)}
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in once], pa.int64()), pa.array([d for _, d in once], pa.binary()), pa.array(once.values(), pa.binary())], names=["rep", "digest", "codes"])

    made = texts.where("id is not null").withColumn("at", F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))).mapInArrow(run, "rep long, digest binary, codes binary")
    return made.groupBy("digest").agg(F.first("codes").alias("codes"))


class Trie:
    """Sets as paths from a root: nodes are segments of elements, cut where paths part or a set ends, and at powers of two so that
    a long path can be left early."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.order = np.array(sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes()))
        paths, self.sizes = [sets[k] for k in self.order], np.asarray(sizes)[self.order]
        self.values = np.unique(np.concatenate(paths))
        ids = [np.searchsorted(self.values, p) for p in paths]
        longs = np.array([len(p) for p in paths])
        shared = np.zeros(len(paths), np.int64)
        for k in range(1, len(paths)):
            n = min(longs[k - 1], longs[k])
            apart = ids[k - 1][:n] != ids[k][:n]
            shared[k] = apart.argmax() if apart.any() else n
        segments, parents, low, high, ends, left = [], [], [], [], [], []
        todo = [(0, len(paths), 0, -1)]
        while todo:
            lo, hi, depth, parent = todo.pop()
            common = int(longs[lo] if hi == lo + 1 else shared[lo + 1 : hi].min())
            while depth < common or parent < 0:
                end = min(common, max(8, 1 << depth.bit_length()))
                segments.append(ids[lo][depth:end])
                parents.append(parent)
                low.append(lo)
                high.append(hi)
                ends.append(0)
                left.append(int(longs[lo:hi].max()) - end)
                depth, parent = end, len(segments) - 1
            at = lo
            while at < hi and longs[at] == common:
                at += 1
            ends[parent] = at - lo
            cuts = [at, *(k for k in range(at + 1, hi) if shared[k] == common), hi]
            todo += [(a, b, common, parent) for a, b in zip(cuts, cuts[1:]) if a < b]
        self.low, self.high, self.ends, self.left = (np.array(x) for x in (low, high, ends, left))
        self.long = np.array([len(s) for s in segments])
        self.begin = np.cumsum(self.long) - self.long
        self.elements = np.concatenate(segments)
        self.last = self.elements[self.begin + self.long - 1]
        self.least = self.over(self.sizes, np.minimum)
        parents = np.array(parents)
        self.child = np.argsort(parents, kind="stable")[1:]  # the root is the first
        self.children = np.bincount(parents[1:], minlength=len(parents))
        self.first = np.cumsum(self.children) - self.children

    def over(self, x: np.ndarray, f: np.ufunc) -> np.ndarray:
        """``f`` over the sets below each node."""
        return f.reduceat(np.append(x, x[-1:]), np.stack([self.low, self.high], 1).ravel())[::2]

    def walk(self, sets: list[np.ndarray], sizes: np.ndarray, percent: int, labels: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(walker, member) of linked pairs; labels of the walkers and of the trie's members tell which are linked already."""
        has = np.zeros((len(sets), len(self.values)), np.uint8)
        rest = np.empty((len(sets), len(self.values)), np.int32)
        for k, s in enumerate(sets):
            at = np.searchsorted(self.values, s)
            rest[k] = len(s) - np.bincount(at, minlength=len(self.values) + 1)[:-1].cumsum()
            inside = at < len(self.values)
            at = at[inside]
            has[k, at[self.values[at] == s[inside]]] = 1
        ranked = own[self.order]
        below = self.over(ranked, np.minimum)
        one = below == self.over(ranked, np.maximum)
        p, v, overlap = np.arange(len(sets)), np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
        walkers, members = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(p):
            keep = ~(one[v] & (below[v] == labels[p]))
            p, v, overlap = p[keep], v[keep], overlap[keep]
            if not len(p):
                break
            long = self.long[v]
            starts = np.cumsum(long) - long
            at = np.arange(int(long.sum())) + np.repeat(self.begin[v] - starts, long)
            overlap = overlap + np.add.reduceat(has[np.repeat(p, long), self.elements[at]], starts, dtype=np.int64)
            need = -(-percent * (sizes[p] + self.least[v]) // (100 + percent))
            keep = overlap + np.minimum(rest[p, self.last[v]], self.left[v]) >= need
            p, v, overlap = p[keep], v[keep], overlap[keep]
            for k in range(int(self.ends[v].max(initial=0))):
                here = np.flatnonzero(self.ends[v] > k)
                member = self.low[v[here]] + k
                good = 100 * overlap[here] >= percent * (sizes[p[here]] + self.sizes[member] - overlap[here])
                walkers.append(p[here][good])
                members.append(self.order[member[good]])
            n = self.children[v]
            at = np.arange(int(n.sum())) + np.repeat(self.first[v] - (np.cumsum(n) - n), n)
            p, v, overlap = np.repeat(p, n), self.child[at], np.repeat(overlap, n)
        return np.concatenate(walkers), np.concatenate(members)


def links_in_trie(trie: list[int], walkers: list[int], sets: list[np.ndarray], sizes: np.ndarray, labels: list, percent: int) -> list[tuple[int, int]]:
    """Links between a walker and a member of the trie (indices of ``sets``) that join unlike labels; ``labels`` are updated."""
    if not trie or not walkers:
        return []
    built = Trie([sets[k] for k in trie], sizes[trie])
    out = []
    width = max(1, min(WALKERS, _CELLS // max(1, len(built.values))))
    now = np.array(labels)
    for at in range(0, len(walkers), width):
        part = walkers[at : at + width]
        for w, m in zip(*(x.tolist() for x in built.walk([sets[k] for k in part], sizes[part], percent, now[part], now[trie]))):
            a, b = part[w], trie[m]
            if now[a] != now[b]:
                out.append((a, b))
                now[now == max(now[a], now[b])] = min(now[a], now[b])
    labels[:] = now.tolist()
    return out


def _join_blocks(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links within the tasks' rows (element, z, i, j, side, own, digest, rep, n, pos, label); between the sides where i is not j."""
    key = ["element", "z", "i", "j"]
    names = [*key, "side", "own", "rep", "n", "label", "codes"]
    # From the group's element on: what a pair shares before it is another group's.
    rows = tasks.join(sets, "digest").withColumn("codes", F.expr("substring(codes, pos * 8 + 1)")).select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []

        def done() -> pa.RecordBatch:
            side, own, rep, size, label, codes = zip(*group)
            known = {x: k for k, x in enumerate(sorted(set(label)))}
            labels, sizes, found = [known[x] for x in label], np.array(size), []
            of = lambda s, only: [k for k in range(len(group)) if side[k] == s and (own[k] if only is None else own[k] in only)]
            if at[2] == at[3]:
                found = links_in_trie(of(0, None), of(0, (True, False)), codes, sizes, labels, percent)
            else:
                found = links_in_trie(of(0, None), of(1, (True, False)), codes, sizes, labels, percent) + links_in_trie(of(1, None), of(0, (False,)), codes, sizes, labels, percent)
            return pa.RecordBatch.from_arrays([pa.array([rep[x] for x, _ in found], pa.int64()), pa.array([rep[y] for _, y in found], pa.int64())], names=["a", "b"])

        for batch in slices(batches, "codes"):
            for *k, side, own, rep, n, label, raw in zip(*(batch.column(c).to_pylist() for c in names)):
                if at != k:
                    if group:
                        yield done()
                    at, group = k, []
                group.append((side, own, rep, n, label, np.frombuffer(raw, np.uint64)))
        if group:
            yield done()

    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def _blocks(size: str, elements: str):
    return F.greatest(F.ceil(F.col(size) / BLOCK), F.ceil(F.col(elements) / BLOCK_ELEMENTS)).cast("int")


def _between_blocks(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Tasks for groups of several blocks: members that lack the label that most have meet each other and all the rest."""
    group, c = ["element", "z"], F.col
    labelled = members.join(roots.select(c("node").alias("rep"), "root"), "rep", "left").withColumn("label", F.coalesce("root", "rep")).drop("root")
    labelled = staged(labelled, "labelled")
    sums = labelled.groupBy(*group, "label").agg(F.count("*").alias("size"), F.sum("n").alias("elements"))
    major = sums.groupBy(*group).agg(F.max(F.struct("size", "elements", "label")).alias("m"), F.sum("size").alias("size"), F.sum("elements").alias("elements")).where(c("size") > c("m.size"))
    dealt = major.select(*group, c("m.label").alias("major"), F.greatest(F.lit(1), F.ceil(c("m.size") / BLOCK), F.ceil(c("m.elements") / BLOCK_ELEMENTS)).cast("int").alias("large"),
                         F.greatest(F.ceil((c("size") - c("m.size")) / BLOCK), F.ceil((c("elements") - c("m.elements")) / BLOCK_ELEMENTS)).cast("int").alias("small"))
    rows = labelled.join(dealt, group).withColumn("most", c("label") == c("major"))
    h = lambda n: F.pmod(F.hash("digest"), c(n))
    # Blocks of the others are 0 to small - 1, those of the most common label follow.
    block = F.when(c("most"), c("small") + h("large")).otherwise(h("small"))
    other = F.explode(F.sequence(F.lit(0), F.when(c("most"), c("small")).otherwise(c("small") + c("large")) - 1))
    pairs = rows.withColumn("block", block).withColumn("other", other)
    return pairs.select(*group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (c("block") > c("other")).cast("int").alias("side"), "own", "digest", "rep", "n", "pos", "label")


def similar_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: key, n_shingles and component_id, the least key that is reachable by links of ``percent`` or more."""
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sketches = staged(_sketches(texts, shingle), "sketches")
    levels = counter_levels(sketches.where("chunk is not null").select("chunk", "counts"))
    rows = sketches.where("chunk is null").select("id", "n", "digest")
    classes = staged(_prefixes(texts, shingle, percent, levels), "prefixes")
    members, groups = _groups(classes, percent)
    chosen = staged(members.join(groups.select("element", "z"), ["element", "z"]).join(classes.select("node", "digest", "rep", "parity"), "node"), "groups")
    left = staged(chosen.drop("parity").join(_sift(chosen, percent), ["element", "z", "node"], "left_semi"), "sifted")
    blocks = left.groupBy("element", "z").agg(F.count("*").alias("size"), F.sum("n").alias("elements")).where("size > 1").select("element", "z", _blocks("size", "elements").alias("blocks"))
    joined = staged(left.join(blocks, ["element", "z"]).drop("node"), "tasks")
    at = F.pmod(F.hash("digest"), F.col("blocks"))
    tasks = joined.select("element", "z", at.alias("i"), at.alias("j"), F.lit(0).alias("side"), "own", "digest", "rep", "n", "pos", F.col("rep").alias("label"))
    links = staged(_join_blocks(tasks, _sets(texts, joined, shingle, levels), percent), "links")
    large = joined.where("blocks > 1").drop("blocks")
    if not large.isEmpty():
        tasks = staged(_between_blocks(large, components(links)), "tasks")
        links = links.unionByName(staged(_join_blocks(tasks, _sets(texts, tasks, shingle, levels), percent), "links"))
    # An id with several texts links their classes.
    several = rows.where("id is not null").groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.min("n").alias("n_min")).where("low != high or low is not null and n_min = 0")
    own = rows.join(several.select("id"), "id", "left_semi").join(classes.select("digest", "rep"), "digest").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    roots = staged(components(links.unionByName(own)), "roots")
    found = classes.select("digest", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("root", "rep").alias("component"))
    empty = rows.where("digest is null").join(roots, F.col("id") == F.col("node"), "left").select("id", "n", F.col("root").alias("component"))
    out = rows.where("digest is not null").join(found, "digest", "left").select("id", "n", "component").unionByName(empty)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
