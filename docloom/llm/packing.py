"""Best-fit packing of documents into sequences of a fixed number of tokens.

What can be packed depends on lengths alone, so the plan is made from the histogram of lengths, which has at most as many
rows as a sequence has tokens, however many documents there are.  Martello and Toth's dominance criterion fixes sets that an
optimal packing may contain: a longest piece goes alone if nothing fits beside it, and with the longest that fits if that one
fills the sequence, or is no shorter than any two that fit while no three do.  Best fit, longest first, packs the rest.  The
plan says, for runs of ranks among pieces of a length, which sequence and place they get; pieces are ranked within (length,
block of hashes), with the blocks' counts as offsets, so that no task sees all pieces of a common length.

Edge cases: a null or empty text is the end mark alone; a document longer than a sequence is cut into full pieces and a last
one that may be shorter; repeated rows and equal ids are packed each; no rows give no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import staged
from docloom.llm.word_bpe import word_bpe

CAPACITY = 2048
END = 0


def cut_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32) and, if asked for, ids (little-endian unsigned 32-bit) of every document's pieces."""
    docs = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = T.StructType([docs.schema[key], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        schema = schema.add("ids", T.BinaryType())
    end, step = END.to_bytes(4, "little"), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_bpe(tokenizer)
        for whole in batches:
            for batch in (whole.slice(at, 512) for at in range(0, whole.num_rows, 512)):
                of, piece, parts = [], [], []
                for i, ids in enumerate(own.encode(batch.column("__text").to_pylist())):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), step)):
                        of.append(i)
                        piece.append(k)
                        parts.append(ids[at : at + step])
                cols = [batch.column(key).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array([k * capacity for k in piece], pa.int64()), pa.array([len(p) // 4 for p in parts], pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(parts, pa.binary())] if with_ids else []), names=schema.names)

    return docs.mapInArrow(run, schema)


class _Stock:
    """Lengths that are left, with their counts, in ascending order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {n: c for n, c in counts.items() if c}
        self.order = sorted(self.count)

    def most(self, room: int) -> int | None:
        k = bisect_right(self.order, room)
        return self.order[k - 1] if k else None

    def take(self, n: int, k: int) -> None:
        self.count[n] -= k
        if not self.count[n]:
            del self.count[n]
            self.order.pop(bisect_right(self.order, n) - 1)

    def least(self, k: int) -> list[int]:
        out: list[int] = []
        for n in self.order:
            out += [n] * min(k - len(out), self.count[n])
            if len(out) == k:
                break
        return out

    def best_pair(self, room: int) -> int:
        """The largest sum of two lengths that is no more than ``room``; 0 if none is."""
        lo, hi, best = 0, bisect_right(self.order, room) - 1, 0
        while lo <= hi:
            a, b = self.order[lo], self.order[hi]
            if a + b > room or (lo == hi and self.count[a] < 2):
                hi -= 1
            else:
                best = max(best, a + b)
                lo += 1
        return best


def reduce_instance(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(sets of lengths that are fixed, with how many times; counts that remain)."""
    stock, fixed = _Stock(counts), []
    for j in sorted(stock.count, reverse=True):
        while stock.count.get(j):
            room = capacity - j
            others = stock if stock.count[j] > 1 else _Stock({n: c for n, c in stock.count.items() if n != j})
            k = others.most(room)
            if k is None:
                fixed.append(((j,), stock.count[j]))
                stock.take(j, stock.count[j])
                continue
            small = others.least(3)
            pair_fits = len(small) > 1 and small[0] + small[1] <= room
            three_fit = len(small) > 2 and sum(small) <= room
            if k == room or not pair_fits or (not three_fit and k >= others.best_pair(room)):
                times = stock.count[j] // 2 if k == j else min(stock.count[j], stock.count[k])
                fixed.append(((j, k), times))
                stock.take(j, times)
                stock.take(k, times)
                continue
            break
    return fixed, stock.count


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first; sequences with the same content are kept as one entry and its count."""
    open_: dict[int, list[list]] = {}  # room -> [content, times]
    rooms: list[int] = []
    done = []

    def put(content: tuple[int, ...], room: int, times: int) -> None:
        if not room:
            done.append((content, times))
            return
        if room not in open_:
            open_[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        open_[room].append([content, times])

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            k = bisect_right(rooms, n - 1)
            if k == len(rooms):  # none has room: open sequences, each as full of this length as it gets
                each = capacity // n
                if left // each:
                    put((n,) * each, capacity - n * each, left // each)
                if left % each:
                    put((n,) * (left % each), capacity - n * (left % each), 1)
                break
            room = rooms[k]
            content, times = open_[room][-1]
            each = max(1, min(room // n, left))
            used = min(times, left // each)
            if used == times:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(k)
            else:
                open_[room][-1][1] -= used
            put(content + (n,) * each, room - n * each, used)
            left -= used * each
    return done + [(c, t) for entries in open_.values() for c, t in entries]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Contents of sequences (lengths, together no more than ``capacity``) and how many have each."""
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def runs_of(contents: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: begin, the first sequence, pieces per sequence and the first one's offset in it."""
    begun: dict[int, int] = {}
    rows, sequence = [], 0
    for content, times in contents:
        offset = 0
        for n in dict.fromkeys(content):
            each = content.count(n)
            begin = begun.get(n, 0)
            rows.append((n, begin, sequence, each, offset))
            begun[n] = begin + each * times
            offset += n * each
        sequence += times
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "begin", "sequence", "each", "offset"))}


def place(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (key, piece, length, ...) with sequence_id and offset.  ``pieces`` is read several times: stage it before."""
    spark = pieces.sparkSession
    blocks = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64(key, "piece"), F.lit(blocks)))
    by_block = staged(dealt.groupBy("length", "block").count(), "lengths")
    # At most ``capacity`` rows, whatever the input.
    counts = {int(r["length"]): int(r["n"]) for r in by_block.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    runs = runs_of(plan(counts, capacity))
    before = by_block.select("length", "block", (F.sum("count").over(W.partitionBy("length").orderBy("block")) - F.col("count")).alias("before"))
    inside = F.row_number().over(W.partitionBy("length", "block").orderBy(key, "piece", "ids_crc32"))
    ranked = dealt.withColumn("inside", inside).join(before, ["length", "block"]).withColumn("rank", F.col("before") + F.col("inside") - 1)
    wide = np.int64(1) << 48
    starts = runs["length"] * wide + runs["begin"]

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(starts, length.to_numpy(np.int64) * wide + rank.to_numpy(np.int64), side="right") - 1
        nth = rank.to_numpy(np.int64) - runs["begin"][at]
        each = runs["each"][at]
        return pd.DataFrame({"sequence_id": runs["sequence"][at] + nth // each, "offset": runs["offset"][at] + nth % each * length.to_numpy(np.int64)})

    return ranked.withColumn("at", placed("length", "rank")).select(*pieces.columns, "at.sequence_id", "at.offset")


def assemble(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, documents): the token sequences themselves, from placed pieces with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"), F.size("parts").alias("documents"))


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(staged(cut_documents(docs, tokenizer, key, text, capacity), "pieces"), key, capacity)
