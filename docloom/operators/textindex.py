"""A positional inverted index: posting lists in blocks with their bounds, in a folder of Parquet files that grows by segments.

A block holds a token's postings in one range of documents: keys, sizes, counts and positions, the block's largest count and
least size.  Ranges are hashes of documents, each of a bounded number of rows and bytes, so a common token has many bounded blocks
and never one long list; one block more of a range names all its documents.  Files are dealt by buckets of tokens and sorted by token, so a search reads its tokens' buckets and
row groups only, and never a text.  Words of a phrase are those whose positions follow each other.

A segment is written whole before its row in ``segments`` is, and readers look at listed segments only: an append that fails
half-way is never seen, and one that is repeated is a segment of another name.

Edge cases: null and empty texts are counted as documents without tokens; rows that share a key stay rows of their own; a null
key is a key like others; a search without terms and phrases has no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.session import shared_dir, ship, staged

#: Documents and bytes of text in a range; buckets of tokens; parts of a bucket, so that a common token is not one task's.
RANGE_ROWS, RANGE_BYTES, BUCKETS, PARTS = 1024, 1 << 23, 16, 8
#: Ranges that are scored in full to learn the score that the last of the top must reach.
FIRST_RANGES = 4
#: Ranges and queries of a task that answers many queries, bytes of its rows of common tokens, documents of phrases that it keeps.
GROUP_RANGES, GROUP_QUERIES, DENSE, HELD = 8, 50_000, 1 << 26, 1 << 20
#: Least queries of a task, where there are more cores than groups of ranges.
LEAST_QUERIES = 1000
#: Most distinct tokens that are sent to all tasks; beyond, tasks get all blocks of their ranges and take what is asked.
TOKENS = 200_000
#: The token of a block of all documents of a range, which no text has.
ALL = "\0"
_ROW = ["segment", "range", "at", "key"]


def _blocks(range_: int, keys: pa.Array, sizes: np.ndarray, tokens: pa.StringArray) -> pa.RecordBatch:
    """A range's blocks: its documents' keys and sizes, and their tokens one after another."""
    coded = tokens.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    at = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
    place = (np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)[order]
    code = code[order]
    new_token = np.diff(code, prepend=-1) != 0
    post = np.flatnonzero(new_token | (np.diff(at, prepend=-1) != 0))  # where a document's places of a token begin
    block = np.searchsorted(post, np.flatnonzero(new_token))  # where a token's documents begin
    ends = lambda starts, n: pa.array(np.append(starts, n).astype(np.int32))
    tf, size = np.diff(np.append(post, len(code))).astype(np.int32), sizes[at[post]].astype(np.int32)
    held = ends(block, len(post))
    starts = (post - np.repeat(post[block], np.diff(np.append(block, len(post))))).astype(np.int32)  # of a document's places in its block's
    lists = lambda values: pa.ListArray.from_arrays(held, values)
    bound = lambda f, x: pa.array(f.reduceat(x, block) if len(block) else x, pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(block), range_), pa.int64()), coded.dictionary, pa.array(np.diff(np.append(block, len(post))), pa.int32()), bound(np.maximum, tf), bound(np.minimum, size),
            lists(pa.array(at[post])), lists(keys.take(pa.array(at[post]))), lists(pa.array(size)), lists(pa.array(tf)), lists(pa.array(starts)), pa.ListArray.from_arrays(ends(post[block], len(code)), pa.array(place)),
        ],
        names=["range", "token", "n", "max_tf", "min_size", "ats", "keys", "sizes", "tfs", "starts", "positions"],
    )


def _all(range_: int, keys: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
    """The block of all documents of a range, also of those without tokens."""
    n = len(sizes)
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    zeros = one(pa.array(np.zeros(n, np.int32)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([range_], pa.int64()), pa.array([ALL]), pa.array([n], pa.int32()), pa.array([0], pa.int32()), pa.array([int(sizes.min())], pa.int32()),
            one(pa.array(np.arange(n, dtype=np.int32))), one(keys), one(pa.array(sizes.astype(np.int32))), zeros, zeros, one(pa.array([], pa.int32())),
        ],
        names=["range", "token", "n", "max_tf", "min_size", "ats", "keys", "sizes", "tfs", "starts", "positions"],
    )


def _post(rows: DataFrame) -> DataFrame:
    """Blocks of (range, key, tokens), whose partitions hold whole ranges in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            tokens = whole.column("tokens").combine_chunks()
            sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = whole.column("key").combine_chunks()
            yield _blocks(now, keys, sizes, tokens.flatten().cast(pa.string()))
            yield _all(now, keys, sizes)

        for batch in batches:
            own = batch.column("range").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and own[a] != now:
                    yield from done()
                    held = []
                now = int(own[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from done()

    return rows.mapInArrow(run, "range long, token string, n int, max_tf int, min_size int, ats array<int>, keys array<long>, sizes array<int>, tfs array<int>, starts array<int>, positions array<int>")


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of lists (0 of null) and their numbers one after another."""
    sizes = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) for c in lists.chunks]
    values = [c.flatten().to_numpy(zero_copy_only=False) for c in lists.chunks]
    return np.concatenate([np.zeros(0, np.int64), *sizes]), np.concatenate([np.zeros(0, np.int32), *values])


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(counts)).astype(np.int64)


class _Postings:
    """The postings of a group of ranges as arrays: documents are numbered by range and place, a token's documents and places ascend."""

    def __init__(self, blocks: pa.Table, docs: pa.Table):
        segments = pa.array(sorted(set(docs["segment"].unique().to_pylist())), pa.string())
        of = lambda t: (pc.fill_null(pc.index_in(t["segment"], value_set=segments), -1).to_numpy().astype(np.int64) << 40) + t["range"].to_numpy()
        own, at = of(docs), docs["at"].to_numpy()
        ranges, order = np.unique(own), np.lexsort((at, own))
        self.n, self.keys, self.scopes = len(own), docs["key"].to_numpy()[order], docs["scope"].to_numpy()[order]
        width = int(at.max()) + 1
        number = np.full(len(ranges) * width, -1, np.int64)  # of the document at each place of a range
        number[np.searchsorted(ranges, own[order]) * width + at[order]] = np.arange(self.n)
        theirs, tokens = of(blocks), pa.concat_arrays([pa.array([], pa.string()), *blocks["token"].chunks]).dictionary_encode()
        r = np.minimum(np.searchsorted(ranges, theirs), len(ranges) - 1)
        code = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((r, code))
        order = order[ranges[r[order]] == theirs[order]]
        blocks = blocks.select(["ats", "tfs", "positions"]).take(pa.array(order))
        (sizes, ats), (_, tfs), (held, positions) = (_flat(blocks[c]) for c in ("ats", "tfs", "positions"))
        d = np.where(ats < width, number[np.repeat(r[order] * width, sizes) + np.minimum(ats, width - 1)], -1)
        code, said = np.repeat(code[order], sizes), np.repeat(held > 0, sizes)
        self.tokens, self.keep = tokens.dictionary, d >= 0
        total = len(self.tokens)
        each = np.repeat(d[said], tfs[said])
        self.spots = ((each << 32) + positions)[each >= 0]
        said &= self.keep
        self.spot_ends = _ends(np.bincount(code[said], weights=tfs[said], minlength=total))
        self.docs, self.tfs = d[self.keep], tfs[self.keep]
        self.ends = _ends(np.bincount(code[self.keep], minlength=total))
        self.code = dict(zip(self.tokens.to_pylist(), range(total)))
        self.none = np.zeros(0, np.int64)

    def common(self, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's row, or -1, among the common ones; and for these whether, and how often, each document has them."""
        df = np.diff(self.ends)
        most = np.argsort(-df, kind="stable")[: max(1, DENSE // (self.n * 5))]
        most = most[df[most] * 16 >= self.n]
        row, has, times = np.full(len(df), -1), np.zeros((len(most), self.n), kind), np.zeros((len(most), self.n), np.int32)
        row[most] = np.arange(len(most))
        for i, t in enumerate(most.tolist()):
            own = slice(self.ends[t], self.ends[t + 1])
            has[i, self.docs[own]], times[i, self.docs[own]] = 1, self.tfs[own]
        return row, has, times

    def pairs(self, asked: set[tuple]) -> dict[tuple, np.ndarray]:
        """The documents of each of the pairs of words that follow each other somewhere, by one walk through all places."""
        total = len(self.tokens)
        wanted = {self.code[a] * total + self.code[b]: (a, b) for a, b in asked if a in self.code and b in self.code}
        codes = np.array(sorted(wanted), np.int64)
        if not len(codes) or not len(self.spots):
            return {}
        of, at = self.spots >> 32, self.spots & 0xFFFFFFFF
        last = np.full(self.n, -1)
        np.maximum.at(last, of, at)
        begin = _ends(last + 2)  # a place without a word parts two documents
        words = np.full(begin[-1] + 1, -1, np.int32)
        words[begin[of] + at] = np.repeat(np.arange(total, dtype=np.int32), np.diff(self.spot_ends))
        first, second = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        first[codes // total], second[codes % total] = True, True
        place = np.flatnonzero(first[words[:-1]] & second[words[1:]])
        pair = words[place].astype(np.int64) * total + words[place + 1]
        k = np.minimum(np.searchsorted(codes, pair), len(codes) - 1)
        hit = codes[k] == pair
        k, doc = k[hit], np.searchsorted(begin, place[hit], "right") - 1
        order = np.argsort(k, kind="stable")
        k, doc = k[order], doc[order]
        new = (np.diff(k, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0)
        k, doc = k[new], doc[new]
        ends = np.searchsorted(k, np.arange(len(codes) + 1)).tolist()
        return {wanted[c]: doc[a:b] for c, a, b in zip(codes.tolist(), ends, ends[1:])}

    def with_phrase(self, words: tuple) -> np.ndarray:
        """The documents in which the words follow each other, looked for from the rarest one."""
        codes = [self.code.get(w, -1) for w in words]
        if min(codes) < 0:
            return self.none
        spots = [self.spots[self.spot_ends[t] : self.spot_ends[t + 1]] for t in codes]
        order = sorted(range(len(spots)), key=lambda k: len(spots[k]))
        starts = spots[order[0]] - order[0]
        for k in order[1:]:
            if not len(starts):
                break
            at = np.searchsorted(spots[k], starts + k)
            starts = starts[spots[k][np.minimum(at, len(spots[k]) - 1)] == starts + k]
        return np.unique(starts >> 32)


def _best_of(asked: pa.Table, blocks: pa.Table, docs: pa.Table, pool: int) -> pa.Table:
    """(query, scores, keys): each query's ``pool`` best among the documents of a task; a score has, from its top bits down, what they are ordered by.

    Hits are counted for all documents, by rows of the common tokens; only those with as many hits as ``pool`` of them
    reach, and those with a phrase, go on to be ordered.
    """
    if not len(asked) or not len(docs) or not len(blocks):
        return pa.table({"query": pa.array([], pa.int64()), "scores": pa.array([], pa.list_(pa.int64())), "keys": pa.array([], pa.list_(pa.int64()))})
    posts = _Postings(blocks, docs)
    n, keys, phrases = posts.n, posts.keys, {}
    asked_phrases = asked["phrases"].to_pylist()
    two = {tuple(ws) for sought in asked_phrases for ws in sought or () if ws and len(ws) == 2}
    pairs = posts.pairs(two)
    words = pa.chunked_array([c.flatten() for c in asked["terms"].chunks], pa.string())
    sizes = np.concatenate([pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) for c in asked["terms"].chunks])
    codes, at = pc.fill_null(pc.index_in(words, value_set=posts.tokens), -1).to_numpy(), _ends(sizes).tolist()
    kind = np.uint8 if sizes.max() < 255 else np.uint16 if sizes.max() < 65535 else np.int64
    row, has, times = posts.common(kind)
    hits, tf, flag, allowed, stored = np.zeros(n, kind), np.zeros(n, np.int64), np.zeros(n, bool), {}, 0
    ends, post_docs, post_tfs = posts.ends.tolist(), posts.docs, posts.tfs
    out_scores, out_keys, counts = [], [], []
    for q, (sought, limited, sees) in enumerate(zip(asked_phrases, asked["limited"].to_pylist(), asked["scopes"].to_pylist())):
        if limited:
            of = tuple(sees)
            if of not in allowed:
                allowed[of] = np.isin(posts.scopes.astype(object), np.array(of, object)).astype(kind) if len(of) else np.zeros(n, kind)
                if not allowed[of].any():
                    allowed[of] = None
            if allowed[of] is None:
                counts.append(0)
                continue
        terms = codes[at[q] : at[q + 1]]
        terms = terms[terms >= 0].tolist()
        dense = [i for i in row[terms].tolist() if i >= 0]
        rare = [(ends[t], ends[t + 1]) for t in terms if row[t] < 0]
        hits.fill(0)
        for i in dense:
            np.add(hits, has[i], out=hits)
        for a, b in rare:
            hits[post_docs[a:b]] += 1
        needle = posts.none
        for ws in sought or ():
            if ws:
                ws = tuple(ws)
                if ws in two:
                    found = pairs.get(ws, posts.none)
                    needle = found if not len(needle) else np.union1d(needle, found)
                    continue
                if ws not in phrases:
                    if stored > HELD:
                        phrases, stored = {}, 0
                    phrases[ws] = posts.with_phrase(ws)
                    stored += len(phrases[ws]) + 16
                needle = phrases[ws] if not len(needle) else np.union1d(needle, phrases[ws])
        if limited:
            np.multiply(hits, allowed[of], out=hits)
            needle = needle[allowed[of][needle] > 0]
        if len(needle) >= pool:
            d = needle
        else:
            least = next((h for h in range(len(terms), 1, -1) if np.count_nonzero(hits >= h) >= pool), 1)
            go = hits >= least
            go[needle] = True
            d = np.flatnonzero(go)
        if not len(d):
            counts.append(0)
            continue
        flag[needle] = True
        tf.fill(0)
        for a, b in rare:
            tf[post_docs[a:b]] += post_tfs[a:b]
        sums = tf[d]
        for i in dense:
            sums += times[i, d]
        h = hits[d].astype(np.int64)
        score = (flag[d].astype(np.int64) << 61) + ((h == at[q + 1] - at[q]) & (h > 0)).astype(np.int64) * (1 << 60) + (h << 40) + sums
        flag[needle] = False
        if len(d) > pool:
            some = score >= np.partition(score, len(d) - pool)[len(d) - pool]
            d, score = d[some], score[some]
        best = np.lexsort((keys[d], -score))[:pool]
        out_scores.append(score[best])
        out_keys.append(keys[d[best]])
        counts.append(len(best))
    counts = np.array(counts, np.int64)
    told = asked["query"].to_numpy()[counts > 0]
    places = pa.array(_ends(counts[counts > 0]).astype(np.int32))
    lists = lambda parts: pa.ListArray.from_arrays(places, pa.array(np.concatenate([posts.none, *parts]), pa.int64()))
    return pa.table({"query": pa.array(told, pa.int64()), "scores": lists(out_scores), "keys": lists(out_keys)})


def _first_of(found: DataFrame, pool: int) -> DataFrame:
    """(query, key, needle, all_terms, hits, tf, rank) of each query's ``pool`` best in (query, scores, keys) of all tasks."""

    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        (sizes, scores), (_, keys) = _flat(rows["scores"]), _flat(rows["keys"])
        query = np.repeat(rows["query"].to_numpy(), sizes)
        order = np.lexsort((keys, -scores, query))
        query, scores, keys = query[order], scores[order], keys[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
        query, scores, keys, rank = (x[rank <= pool] for x in (query, scores, keys, rank))
        bit = lambda k: pa.array((scores >> k & 1).astype(bool))
        columns = [pa.array(query, pa.int64()), pa.array(keys, pa.int64()), bit(61), bit(60), pa.array(scores >> 40 & (1 << 20) - 1, pa.int64()), pa.array(scores & (1 << 40) - 1, pa.int64()), pa.array(rank.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["query", "key", "needle", "all_terms", "hits", "tf", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if batch.num_rows:
                rest = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
                query = rest["query"].to_numpy()
                cut = int(np.searchsorted(query, query[-1]))  # rows of the last query may go on
                if cut:
                    yield from done(rest.slice(0, cut))
                    rest = rest.slice(cut)
        if rest is not None:
            yield from done(rest)

    return found.repartition("query").sortWithinPartitions("query").mapInArrow(run, "query long, key long, needle boolean, all_terms boolean, hits long, tf long, rank int")


def _moved(positions: str, by: int) -> Column:
    return F.transform(positions, lambda x: x - by)


class TextIndex:
    """The index in a folder; ``append`` adds documents, the searches read what is committed when they are called."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = ship(spark), path, buckets

    def append(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> TextIndex:
        seen = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("size")).first()
        ranges = max(1, math.ceil(seen.n / RANGE_ROWS), math.ceil((seen.size or 0) / RANGE_BYTES))
        segment = "s" + uuid.uuid4().hex
        dealt = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.pmod(F.xxhash64(key, F.length(text)), F.lit(ranges)).alias("range"))
        whole = dealt.repartition(ranges, "range").sortWithinPartitions("range", "key", F.xxhash64("text")).select("range", "key", tx.tokens(F.col("text")).alias("tokens"))
        posted = _post(whole).withColumns({"segment": F.lit(segment), "bucket": self.bucket(F.col("token"))})
        posted = posted.repartition("bucket", F.pmod("range", F.lit(PARTS))).sortWithinPartitions("bucket", "token", "range")
        posted.write.partitionBy("segment", "bucket").mode("append").parquet(f"{self.path}/postings")
        # The words of a text are no more than its postings say; texts are not read again.
        sums = self._read([segment]).agg(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)).alias("words")).first()
        row = self.spark.range(1).select(F.lit(segment).alias("segment"), F.lit(seen.n).cast("long").alias("n"), F.lit(sums.words or 0).cast("long").alias("words"), F.lit(ranges).cast("long").alias("ranges"))
        row.write.mode("append").parquet(f"{self.path}/segments")
        return self

    def bucket(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def segments(self) -> DataFrame:
        """A row for each append: its documents, words and ranges."""
        return self.spark.read.schema("segment string, n long, words long, ranges long").parquet(f"{self.path}/segments")

    def _read(self, segments: list[str]) -> DataFrame:
        kind = "range long, token string, n int, max_tf int, min_size int, ats array<int>, keys array<long>, sizes array<int>, tfs array<int>, starts array<int>, positions array<int>, segment string, bucket int"
        return self.spark.read.schema(kind).parquet(f"{self.path}/postings").where(F.col("segment").isin(segments))

    def blocks(self, tokens: Sequence[str]) -> DataFrame:
        """The committed blocks of some tokens."""
        tokens = list(dict.fromkeys(tokens))
        listed = [r.segment for r in self.segments().select("segment").collect()]  # a row for each append
        if not tokens:
            return self._read(listed).where(F.lit(False))
        buckets = [r.b for r in self.spark.createDataFrame([(t,) for t in tokens], "t string").select(self.bucket(F.col("t")).alias("b")).distinct().collect()]
        return self._read(listed).where(F.col("bucket").isin(buckets) & F.col("token").isin(tokens))

    def postings(self, blocks: DataFrame, positions: bool = False) -> DataFrame:
        """(segment, range, at, key, size, token, tf[, positions]): a row for each document of each block."""
        if positions:
            places = F.transform(F.arrays_zip("starts", "tfs"), lambda x: F.slice("positions", x["starts"] + 1, x["tfs"]))
            blocks = blocks.withColumn("positions", places)
        names = ["ats", "keys", "sizes", "tfs"] + ["positions"] * positions
        each = blocks.select("segment", "range", "token", F.explode(F.arrays_zip(*names)).alias("p"))
        out = each.select("segment", "range", F.col("p.ats").alias("at"), F.col("p.keys").alias("key"), F.col("p.sizes").alias("size"), "token", F.col("p.tfs").alias("tf"), *([F.col("p.positions").alias("positions")] if positions else []))
        return out

    def lexical(self, terms: Sequence[str], phrases: Sequence[str] = (), key: str = "doc_id") -> DataFrame:
        """(key, hits, all_terms, needle, tf) as ``search.lexical`` has them, phrases and document numbers by positions."""
        set_phrases = [w for w in map(tx.words_of, phrases) if w]
        found = self.postings(self.blocks([*terms, *(w for p in set_phrases for w in p)]), bool(set_phrases))
        asked = F.col("token").isin(list(terms)) if terms else F.lit(False)
        needles = {w: f"p{k}" for k, w in enumerate(dict.fromkeys(w for p in set_phrases for w in p))}
        met = found.groupBy(*_ROW).agg(F.count_if(asked).alias("hits"), F.sum(F.when(asked, F.col("tf")).otherwise(0)).alias("tf"), *(F.max(F.when(F.col("token") == w, F.col("positions"))).alias(p) for w, p in needles.items()))
        needle = F.lit(False)
        for words in set_phrases:
            starts = [_moved(needles[w], k) for k, w in enumerate(words)]
            needle = needle | F.coalesce(F.size(reduce(F.array_intersect, starts)) > 0, F.lit(False))
        scored = met.select(F.col("key").alias(key), F.col("hits").cast("int").alias("hits"), F.col("tf").cast("int").alias("tf"), needle.alias("needle"))
        return scored.where("hits > 0 or needle").withColumn("all_terms", F.col("hits") == len(set(terms)))

    def lexical_many(self, queries: DataFrame, query: str = "query", terms: str = "terms", phrases: str = "phrases") -> DataFrame:
        """(query, key, hits, all_terms, needle, tf) for a table of queries with arrays of folded terms and of phrases (arrays of words).

        Terms meet posting blocks by an equal join, so a search is as large as its terms' lists; no text is read.
        """
        listed = [r.segment for r in self.segments().select("segment").collect()]
        asked = queries.select(F.col(query).alias("q"), F.size(F.array_distinct(terms)).alias("of"), F.explode(F.array_distinct(terms)).alias("token"))
        met = self.postings(self._read(listed).join(asked.select("token").distinct(), "token", "left_semi")).join(asked, "token")
        rows = ["q", *_ROW]
        hits = met.groupBy(*rows).agg(F.count("*").alias("hits"), F.sum("tf").alias("tf"), F.max("of").alias("of"))
        words = queries.select(F.col(query).alias("q"), F.posexplode(phrases).alias("phrase", "words")).select("q", "phrase", F.size("words").alias("need"), F.posexplode("words").alias("place", "token"))
        places = self.postings(self._read(listed).join(words.select("token").distinct(), "token", "left_semi"), positions=True).join(words, "token")
        starts = places.withColumn("at_word", F.explode("positions")).withColumn("start", F.col("at_word") - F.col("place")).groupBy(*rows, "phrase", "start").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n = need")
        both = hits.unionByName(starts.select(*rows).distinct().withColumn("needle", F.lit(True)), allowMissingColumns=True)
        out = both.groupBy(*rows).agg(F.coalesce(F.max("hits"), F.lit(0)).alias("hits"), F.coalesce(F.max("tf"), F.lit(0)).alias("tf"), F.max("of").alias("of"), F.coalesce(F.bool_or("needle"), F.lit(False)).alias("needle"))
        return out.select(F.col("q").alias(query), "key", "hits", (F.col("hits") == F.coalesce("of", F.lit(-1))).alias("all_terms"), "needle", "tf")

    def _shares(self, n: int, groups: int) -> int:
        """Shares of ``n`` queries: as many as bound a task, and more where there are fewer groups of ranges than cores."""
        cores = self.spark.sparkContext.defaultParallelism
        return max(1, -(-n // GROUP_QUERIES), min(-(-cores // groups), n // LEAST_QUERIES))

    def best_many(self, queries: DataFrame, rows: DataFrame, pool: int) -> DataFrame:
        """(query, key, needle, all_terms, hits, tf, rank): for each of ``queries`` (query, terms, phrases, scopes) its ``pool`` best of the
        hits that ``lexical_many`` has, among ``rows`` (key, scope) that its scopes allow.

        A task has the blocks of some ranges and some of the queries, and returns its best of each query as one row.
        """
        listed = [r.segment for r in self.segments().select("segment").collect()]
        sums = self.segments().agg(F.sum("n").alias("n"), F.sum("ranges").alias("ranges")).first()
        n_i, n_j = max(1, -(-(sums.ranges or 1) // GROUP_RANGES)), self._shares(queries.count(), max(1, -(-(sums.ranges or 1) // GROUP_RANGES)))
        part = F.pmod(F.pmod(F.xxhash64("segment"), F.lit(n_i)) + F.col("range"), F.lit(n_i)) * n_j
        every = F.explode(F.sequence(F.lit(0), F.lit(n_j - 1)))
        words = queries.select(F.explode(F.flatten("phrases")).alias("token")).distinct().withColumn("said", F.lit(True))
        tokens = staged(queries.select(F.explode("terms").alias("token")).distinct().join(words, "token", "full"), "tokens")
        met = self._read(listed).where(F.col("token") != ALL)
        if tokens.count() <= TOKENS:
            met = met.join(F.broadcast(tokens), "token").withColumn("positions", F.when(F.col("said"), F.col("positions")))
        own = rows.groupBy("key").agg(F.min("scope").alias("scope"))
        held = self._read(listed).where(F.col("token") == ALL).select("segment", "range", F.explode(F.arrays_zip("ats", "keys")).alias("p")).select("segment", "range", F.col("p.ats").alias("at"), F.col("p.keys").alias("key"))
        if held.count() != (sums.n or 0):
            raise ValueError(f"the index in {self.path} has no list of its documents; build it again")
        docs = held.join(own, "key")
        asked = queries.where("query is not null").withColumn("terms", F.array_distinct("terms")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_i - 1)))).withColumn("g", F.col("i") * n_j + F.pmod(F.xxhash64("query"), F.lit(n_j)))
        names = {"kind": "int", "g": "int", "query": "long", "key": "long", "segment": "string", "range": "long", "at": "int", "scope": "string", "terms": "array<string>", "phrases": "array<array<string>>", "limited": "boolean", "scopes": "array<string>", "token": "string", "ats": "array<int>", "tfs": "array<int>", "positions": "array<int>"}

        def as_kind(kind: int, df: DataFrame, *own: str) -> DataFrame:
            # Arrays are empty and never null: with nulls, handing rows to Python took ten times the CPU.
            none = lambda c: F.array() if names[c].startswith("array") else F.lit(0 if c in ("query", "key", "range", "at") else None)
            value = lambda c: F.coalesce(F.col(c).cast(names[c]), none(c).cast(names[c])) if c in own else F.col(c) if c == "g" else none(c)
            return df.select(F.lit(kind).alias("kind"), *(value(c).cast(t).alias(c) for c, t in names.items() if c != "kind"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            whole = pa.Table.from_batches(held) if held else None
            del held
            of = {} if whole is None else {g: [whole.filter(pc.and_(pc.equal(whole["g"], g), pc.equal(whole["kind"], kind))) for kind in range(3)] for g in whole["g"].unique().to_pylist()}
            del whole  # its rows are held once
            for parts in of.values():
                yield from _best_of(*parts, pool).to_batches(max_chunksize=10_000)

        rows_of = [as_kind(0, asked.withColumn("limited", F.col("scopes").isNotNull()), "query", "terms", "phrases", "limited", "scopes"), as_kind(1, met.withColumn("j", every).withColumn("g", part + F.col("j")), "segment", "range", "token", "ats", "tfs", "positions"), as_kind(2, docs.withColumn("j", every).withColumn("g", part + F.col("j")), "segment", "range", "at", "key", "scope")]
        dealt = reduce(DataFrame.unionByName, rows_of).repartitionById(n_i * n_j, "g")
        return _first_of(dealt.mapInArrow(run, "query long, scores array<long>, keys array<long>"), pool)

    def with_phrase(self, phrases: Sequence[str], key: str = "doc_id") -> DataFrame:
        """(key) of rows with one of the phrases; a document number is a phrase, whatever stands between its parts."""
        return self.lexical((), phrases, key).where("needle").select(key)

    def _weights(self, blocks: DataFrame, terms: Sequence[str]) -> tuple[dict[str, float], float]:
        """Each term's weight, and the mean size; a row for each term."""
        sums = self.segments().agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
        n, held = sums.n or 0, {r.token: r.d for r in blocks.groupBy("token").agg(F.sum("n").alias("d")).collect()}
        return {t: math.log(1 + (n - held.get(t, 0) + 0.5) / (held.get(t, 0) + 0.5)) for t in terms}, (sums.words or 0) / n if n and sums.words else 1.0

    @staticmethod
    def _score(tf: Column, size: Column, weights: dict[str, float], mean: float, k1: float, b: float) -> Column:
        weight = F.lit(0.0)
        for t, w in weights.items():
            weight = F.when(F.col("token") == t, F.lit(w)).otherwise(weight)
        return weight * tf / (tf + k1 * (1 - b + b * size / mean))

    def bm25(self, terms: Sequence[str], key: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(key, bm25) of all rows with any term."""
        blocks = self.blocks(terms)
        weights, mean = self._weights(blocks, list(dict.fromkeys(terms)))
        return self._sums(blocks, weights, mean, k1, b).select(F.col("key").alias(key), "bm25").where("bm25 > 0")

    def _sums(self, blocks: DataFrame, weights: dict[str, float], mean: float, k1: float, b: float) -> DataFrame:
        score = self._score(F.col("tf").cast("double"), F.col("size"), weights, mean, k1, b)
        return self.postings(blocks).groupBy(*_ROW).agg(F.sum(score).alias("bm25"))

    def ranges(self, blocks: DataFrame, weights: dict[str, float], mean: float, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(segment, range, most): what a document of a range can score at most, by its blocks' bounds."""
        return blocks.groupBy("segment", "range").agg(F.sum(self._score(F.col("max_tf").cast("double"), F.col("min_size"), weights, mean, k1, b)).alias("most"))

    def top(self, terms: Sequence[str], k: int = 10, key: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(key, bm25) of the ``k`` best rows, ties by key.  Ranges whose bound is below the k-th score of the first ones are not read."""
        kept, weights, mean = self.promising(terms, k, k1, b)
        return self._sums(kept, weights, mean, k1, b).where("bm25 > 0").orderBy(F.desc("bm25"), "key").limit(k).select(F.col("key").alias(key), "bm25")

    def promising(self, terms: Sequence[str], k: int, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame, dict[str, float], float]:
        """The blocks of the ranges that can hold one of the ``k`` best, and the terms' weights."""
        blocks = self.blocks(terms)
        weights, mean = self._weights(blocks, list(dict.fromkeys(terms)))
        bounds = staged(self.ranges(blocks, weights, mean, k1, b), "bounds")
        first = bounds.orderBy(F.desc("most"), "segment", "range").limit(max(FIRST_RANGES, k))
        # At most k scores, of which the last is what others must reach.
        best = [r.bm25 for r in self._sums(blocks.join(first, ["segment", "range"], "left_semi"), weights, mean, k1, b).orderBy(F.desc("bm25")).limit(k).select("bm25").collect()]
        least = best[-1] - 1e-9 if len(best) == k else 0.0
        return blocks.join(bounds.where(F.col("most") >= least), ["segment", "range"], "left_semi"), weights, mean


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> TextIndex:
    return TextIndex(docs.sparkSession, path, buckets).append(docs, key, text)


def index_of(docs: DataFrame, name: str, key: str = "doc_id", text: str = "text") -> TextIndex:
    """The application's index of a table that does not change, made when it is first asked for; it goes with the staged tables."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    known = getattr(sc, "_docloom_indexes", None) or {}
    if (name, key, text) not in known:
        sc._docloom_indexes = known
        known[name, key, text] = build(docs, f"{shared_dir(spark)}/docloom/{sc.applicationId}/index-{uuid.uuid4().hex}", key, text)
    return known[name, key, text]
