"""How filters interact: what each keeps, removes, removes again or removes alone, in every order of applying them.

A document is the set of filters that it fails, as a mask of five bits, and all that happens to it in an order follows from its
mask.  So documents become counts by part and mask (all, good and toxic ones), and these rows, times integer matrices of 32
masks by 600 outcomes (120 orders of 5 steps), give every order's figures without another look at a text.

Texts are read once, by built-in functions, into a narrow staged table.  Whether a text repeats one of a smaller id is asked by
an equal join of (digest, id) with each digest's least id, so that a group of copies is no key of its own.

Edge cases: a null or empty text has no words and fails A alone, or with E; a row without an id repeats nothing, is repeated by nothing
and has no label; rows that share an id and a text count each, and do not repeat each other; an id with several labels is good
(toxic) if one of them says so; a null source is the part ''; an empty table has no parts, hence no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACES, staged

#: Least words, least percentage of distinct words, most percentage of capitals, and the symbols that fail.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 200, 50, 2, "[#$%&*|]"
FILTERS = "ABCDE"
CLASSES = ["n", "good", "toxic"]


def text_mask(text: Column) -> Column:
    """The bits of the filters A to D, which look at one text."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.filter(F.split(bare, SPACES + "+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n, 100 * capitals > MAX_CAPITALS * F.length(text), F.rlike(text, F.lit(SYMBOLS))]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): numbers of documents by part and failed filters."""
    body = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    judged = body.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_mask(F.col("text")).alias("own"))
    rows = staged(judged.groupBy("id", "digest", "part", "own").agg(F.count("*").alias("n")), "masks")
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).select("digest", "id", F.lit(1).alias("first"))
    told = rows.join(first, ["digest", "id"], "left")
    again = F.col("id").isNotNull() & F.col("first").isNull()
    # Rows without an id are many keys, not one: the digest stands in for the id.
    told = told.select("id", F.when(F.col("id").isNull(), F.col("digest")).otherwise(F.lit(b"")).alias("salt"), "part", "n", (F.col("own") + F.when(again, 1 << 4).otherwise(0)).alias("mask"))
    yes = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marked = labels.select(F.col(key).alias("id"), "quality", "toxic").where("id is not null").groupBy("id").agg(yes("quality"), yes("toxic")).withColumn("salt", F.lit(b""))
    count = lambda c, name: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(name)
    return told.join(marked, ["id", "salt"], "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), count("quality", "good"), count("toxic", "toxic"))


def outcomes(filters: str = FILTERS) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The columns (order, step), and for each outcome a matrix of masks by columns: what one document of a mask adds there."""
    orders = ["".join(o) for o in permutations(filters)]
    columns = [(o, s) for o in orders for s in range(1, len(filters) + 1)]
    mask = np.arange(1 << len(filters))[:, None]
    own = np.array([1 << filters.index(o[s - 1]) for o, s in columns])[None, :]
    before = np.array([sum(1 << filters.index(f) for f in o[: s - 1]) for o, s in columns])[None, :]
    fails, gone = (mask & own) > 0, (mask & before) > 0
    # Over all orders, each filter that a document fails removes it equally often.
    failed = np.array([max(1, m.bit_count()) for m in range(1 << len(filters))])[:, None]
    found = {"kept": ~gone & ~fails, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == own, "shapley": fails * (len(orders) // failed)}
    return columns, {name: x.astype(np.int64) for name, x in found.items()}


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order's steps for each part of (part, mask, n, good, toxic), by one product of matrices for each outcome."""
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, by = outcomes(filters)
        orders, steps = pa.array([o for o, _ in columns]), pa.array([s for _, s in columns], pa.int32())
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                parts = rows.num_rows
                stacked = np.zeros((len(CLASSES), parts, 1 << len(filters)), np.int64)
                for i, cells in enumerate(rows.column("cells").to_pylist()):
                    for cell in cells:
                        stacked[:, i, cell["mask"]] += [cell[c] for c in CLASSES]
                every, good, toxic = stacked
                made = {name: every @ matrix for name, matrix in by.items()} | {"good_lost": good @ by["removed"], "toxic_lost": toxic @ by["removed"]}
                part = rows.column("part").take(pa.array(np.repeat(np.arange(parts), len(columns))))
                tiled = pa.array(np.tile(np.arange(len(columns)), parts))
                yield pa.RecordBatch.from_arrays([part, orders.take(tiled), steps.take(tiled), *(pa.array(made[c].ravel()) for c in names)], names=["part", "filter_order", "step", *names])

    # A part has one cell for each mask at most.
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *CLASSES)).alias("cells"))
    return cells.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names))


def audit_filters(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the filters A to E and step, with counts of the part's documents."""
    return audit(masks(docs, labels, key, text, part))
