"""Byte-level BPE encoding and decoding with overlapping chunks.

A long text is cut into chunks that overlap, so that one text keeps many tasks busy.  Each chunk is pre-tokenised from its
own start.  The splitting pattern never looks back, so as soon as two neighbours have a pre-token boundary at the same place
in their overlap, they agree from there on: the text is stitched at that place, and each chunk's piece is encoded by itself.
Decoding concatenates the raw bytes of the tokens.

Edge cases: null and empty texts have no ids; if neighbours don't agree within an overlap (one run of letters longer than
it), the text is encoded whole; repeated rows and several texts under one key are all returned.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points of a chunk's own part, and of its overlap with the next.
CHUNK, OVERLAP = 1 << 15, 1 << 10
#: A boundary this near to the end of a cut-off chunk may depend on what follows.
_LOOK = 4
_made: dict = {}


def encoding(ranks: str, pattern: str):
    """The tokenizer of a rank file, made once in each process."""
    if (ranks, pattern) not in _made:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _made[ranks, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _made[ranks, pattern]


def _splitter(pattern: str):
    if pattern not in _made:
        import regex

        _made[pattern] = regex.compile(pattern)
    return _made[pattern]


def encode(text: str, ranks: str, pattern: str) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    return encoding(ranks, pattern).encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes() if text else b""


def decode_bytes(ids: bytes, ranks: str, pattern: str) -> bytes:
    own = encoding(ranks, pattern)
    if (ranks, pattern, "bytes") not in _made:
        table = [b""] * (own.max_token_value + 1)
        for i in own._mergeable_ranks.values():
            table[i] = own.decode_single_token_bytes(i)
        _made[ranks, pattern, "bytes"] = table
    return b"".join(map(_made[ranks, pattern, "bytes"].__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _by_bytes(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes in ``column`` each."""
    sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
    ends = np.searchsorted(np.cumsum(sizes) // most, np.arange(int(sizes.sum()) // most + 1), side="right") if len(sizes) else []
    start = 0
    for end in ends:
        if end > start:
            yield batch.slice(start, end - start)
            start = int(end)


def _map_column(df: DataFrame, source: str, result: str, f, keep: list[str]) -> DataFrame:
    """``keep`` and ``result`` = f(value of ``source``), bytes, a few MB of rows at a time."""
    df = df.select(*keep, F.col(source).alias("__in"))
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(result, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_bytes(whole, "__in"):
                made = pa.array([f(x.as_py()) for x in batch.column("__in")], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [made], names=[*keep, result])

    return df.mapInArrow(run, schema)


def _chunk(text: str, last: bool, chunk: int, overlap: int, ranks: str, pattern: str) -> dict:
    """A chunk's ids, and the boundaries (with the ids before them) that neighbours may share with it."""
    ends = np.fromiter((m.end() for m in _splitter(pattern).finditer(text)), np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    sure = ends if last else ends[ends <= len(text) - _LOOK]
    places = np.concatenate([[0], sure])
    counts, ids, at = [0], [], 0
    own = encoding(ranks, pattern)
    wanted = (places <= overlap) | (places >= chunk)
    if last and len(places):
        wanted[-1] = True
    stops = places[wanted]
    for a, b in zip(stops[:-1], stops[1:]):
        piece = own.encode_to_numpy(text[a:b], disallowed_special=()).astype("<u4", copy=False).tobytes()
        ids.append(piece)
        at += len(piece)
        counts.append(at)
    return {"places": stops.tolist(), "counts": counts, "ids": b"".join(ids)} if len(starts) or text == "" else {"places": [0], "counts": [0], "ids": b""}


def stitch(chunks: list[tuple[int, list[int], list[int], bytes]], chunk: int) -> bytes | None:
    """The ids of the text from (number, places, ids before them, ids) of its chunks; None if neighbours don't agree."""
    out, begin = [], 0
    for k, (no, places, counts, ids) in enumerate(chunks):
        count = dict(zip(places, counts))
        start = begin - no * chunk
        if start not in count:
            return None
        if k + 1 == len(chunks):
            out.append(ids[count[start] :])
            break
        nxt = {p + chunk for p in chunks[k + 1][1]}
        meet = next((p for p in places if p >= chunk and p in nxt and p >= start), None)
        if meet is None:
            return None
        out.append(ids[count[start] : count[meet]])
        begin = no * chunk + meet
    return b"".join(out)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, ids) for every row of ``docs``: ids as little-endian unsigned 32-bit integers."""
    docs = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("body"))
    short = _map_column(docs.where(F.length("body") <= chunk + overlap), "body", "ids", lambda t: encode(t, ranks, pattern), [key])

    long = docs.where(F.length("body") > chunk + overlap).withColumn("told", F.sha2("body", 256))
    numbers = F.sequence(F.lit(0), F.floor((F.length("body") - 1 - overlap) / chunk).cast("int"))
    cut = long.select(F.col(key).alias("key"), "told", "body", F.size(numbers).alias("chunks"), F.explode(numbers).alias("no")).select(
        "key", "told", "chunks", "no", F.expr(f"substring(body, no * {chunk} + 1, {chunk + overlap})").alias("part")
    )
    cut = cut.repartition(F.xxhash64("key", "told", "no"))
    kind = T.StructType([*cut.schema.fields, T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("ids", T.BinaryType())])

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_chunk(p.as_py(), n.as_py() + 1 == c.as_py(), chunk, overlap, ranks, pattern) for p, n, c in zip(batch.column("part"), batch.column("no"), batch.column("chunks"))]
            more = [pa.array([r["places"] for r in rows], pa.list_(pa.int32())), pa.array([r["counts"] for r in rows], pa.list_(pa.int32())), pa.array([r["ids"] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "places", "counts", "ids"])

    def join_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
        copies = int((pdf["no"] == 0).sum())
        one = pdf.drop_duplicates("no").sort_values("no")
        ids = stitch([(int(r.no), list(r.places), list(r.counts), bytes(r.ids)) for r in one.itertuples()], chunk)
        if ids is None:
            last = len(one) - 1
            ids = encode("".join(p if i == last else p[:chunk] for i, p in enumerate(one["part"])), ranks, pattern)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]] * copies, "ids": [ids] * copies})

    joined = cut.mapInArrow(encode_chunks, kind).groupBy("key", "told").applyInPandas(join_chunks, T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("ids", T.BinaryType())]))
    return short.unionByName(joined.withColumnRenamed("key", key))


def decode_documents(encoded: DataFrame, ranks: str, pattern: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) and ``bytes``: the raw bytes of the ids' tokens, in order."""
    keep = encoded.columns if keep is None else keep
    return _map_column(encoded, ids, "bytes", lambda x: decode_bytes(x or b"", ranks, pattern), keep)


def n_tokens(ids: Column) -> Column:
    return (F.length(ids) / 4).cast("long")
