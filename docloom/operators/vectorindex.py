"""An exact vector index: cells around pivots, and bounds by angles that skip whole cells.

Angles between vectors are distances, so a vector at angle a to a pivot is at least a - r from all members of the pivot's cell,
whose largest angle is r.  A row visits the cells that its bound allows and no others: those that can hold a partner of the
least cosine, or for nearest neighbours those that can beat the k-th of the nearest cells.  Nothing is lost by it.

Pivots are spread over a bounded sample (each next one is the farthest from those before); every row is indexed.  Cells are
dealt to blocks of bounded size, large cells to several.  A task has one block of members and the rows of one block that visit it,
so both sides are bounded, and pairs of blocks without a visit are never made.  There are about ``BLOCKS`` of them while that keeps
to ``MOST`` rows, so a row is sent a bounded number of times; cosines are made in strips, of the cells that a strip's rows visit.

Edge cases: rows without a vector are left out; a vector of zeros has cosine 0 with all, so it is in a cell that everyone visits, and
it visits all; ties go to the lesser key; rows that share a key are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.session import staged

#: Most pivots, rows of the sample that they come from, and least members of a block.
PIVOTS, SAMPLE, BLOCK = 512, 4096, 2000
#: Blocks that a side is dealt to, most members of one, and cosines that are made at once.
BLOCKS, MOST, STRIP = 16, 50_000, 1 << 22
#: Added to angles, as cosines near 1 tell them apart no better.
_SLACK = 1e-6


def unit(v) -> np.ndarray:
    x = np.stack([np.asarray(a, np.float64) for a in v])
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def spread(x: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` rows, each the farthest from those before."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(most, len(x)):
        k = int(near.argmin())
        if near[k] > 1 - 1e-9:
            break
        chosen.append(k)
        near = np.maximum(near, x @ x[k])
    return x[chosen]


class VectorIndex:
    """(id, v, cell) of all rows, the pivots, and each cell's size and largest angle (a row for each pivot)."""

    def __init__(self, members: DataFrame, pivots: np.ndarray):
        self.members, self.pivots = members, pivots
        cells = len(pivots) + 1  # the last is that of zeros
        self.sizes, self.radius = np.zeros(cells, np.int64), np.zeros(cells)
        for r in members.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect():
            self.sizes[r.cell], self.radius[r.cell] = r.n, r.r
        self.radius[-1] = np.inf

    @classmethod
    def build(cls, corpus: DataFrame, key: str = "vec_id", vector: str = "embedding", pivots: int | None = None, tag: str | None = None) -> VectorIndex:
        rows = cls._rows(corpus, key, vector, tag)
        most = pivots or min(PIVOTS, max(1, int(rows.count() ** 0.5)))
        sample = [r.v for r in rows.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).select("v").collect()]
        x = unit(sample) if sample else np.zeros((0, 1))
        x = x[np.abs(x).sum(axis=1) > 0]
        found = spread(x, most) if len(x) else np.zeros((0, x.shape[1]))
        return cls(staged(cls._assign(rows, found), "cells"), found)

    @staticmethod
    def _rows(corpus: DataFrame, key: str, vector: str, tag: str | None) -> DataFrame:
        own = F.lit(None).cast("string") if tag is None else F.col(tag).cast("string")
        return corpus.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), own.alias("tag"))

    def append(self, corpus: DataFrame, key: str = "vec_id", vector: str = "embedding", tag: str | None = None) -> VectorIndex:
        """The index with more rows, in cells of the same pivots."""
        rows = self._rows(corpus, key, vector, tag)
        return VectorIndex(self.members.unionByName(staged(self._assign(rows, self.pivots), "cells")), self.pivots)

    @staticmethod
    def _assign(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
        extra = [c for c in rows.columns if c not in ("id", "v")]
        kind = f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, " + "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in extra) + "cell int, angle double"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x = unit(pdf.v)
                    zero = np.abs(x).sum(axis=1) == 0
                    s = x @ pivots.T if len(pivots) else np.zeros((len(x), 1))
                    cell = np.where(zero, len(pivots), s.argmax(axis=1)).astype(np.int32)
                    yield pd.DataFrame({"id": pdf.id, "v": list(x), **{c: pdf[c] for c in extra}, "cell": cell, "angle": np.where(zero, 0.0, np.arccos(np.clip(s.max(axis=1), -1, 1)))})

        return rows.mapInPandas(run, kind)

    @staticmethod
    def _deal(sizes: np.ndarray) -> tuple[list[int], list[int]]:
        """Each cell's first block and number of blocks: large cells have several, small ones share one."""
        start, parts, block, room = [], [], -1, 0
        most = max(BLOCK, min(MOST, -(-int(sizes.sum()) // BLOCKS)))
        for n in sizes.tolist():
            k = max(1, -(-n // most))
            if k > 1 or n > room:
                start.append(block + 1)
                block, room = block + k, 0 if k > 1 else most - n
            else:
                start.append(block)
                room -= n
            parts.append(k)
        return start, parts

    def _visits(self, rows: DataFrame, least: float | None, first: int | None) -> DataFrame:
        """``rows`` (id, v, cell[, reach]) with the cells that each must visit: those of a cosine of ``least`` or within its ``reach``;
        ``first``: the nearest ones that hold so many members (with ``reach``: none of these)."""
        pivots, radius, sizes = self.pivots, self.radius, self.sizes
        names = [c for c in rows.columns if c != "reach"]
        kind = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names) + ", visits array<int>, mask binary"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack(list(pdf.v))
                angle = np.full((len(x), len(radius)), 0.0)
                if len(pivots):
                    angle[:, :-1] = np.arccos(np.clip(x @ pivots.T, -1, 1))
                angle[np.abs(x).sum(axis=1) == 0] = 0.0
                low = angle - radius[None, :]
                near = np.zeros(low.shape, bool)
                if first is not None:
                    order = np.argsort(low, axis=1, kind="stable")
                    held = np.cumsum(sizes[order], axis=1)
                    np.put_along_axis(near, order, (held - sizes[order]) < first, axis=1)
                if "reach" in pdf:
                    go = (low <= pdf.reach.fillna(np.inf).to_numpy()[:, None] + _SLACK) & ~near
                else:
                    go = near if least is None else low <= np.arccos(np.clip(least, -1, 1)) + _SLACK
                go &= sizes[None, :] > 0
                yield pdf[names].assign(visits=[np.flatnonzero(g).astype(np.int32) for g in go], mask=[m.tobytes() for m in np.packbits(go, axis=1)])

        return rows.mapInPandas(run, kind).where("size(visits) > 0")

    def comparisons(self, visits: DataFrame) -> int:
        """How many pairs of rows the visits compare."""
        sizes = F.array(*(F.lit(int(n)) for n in self.sizes))
        return visits.select(F.explode("visits").alias("c")).agg(F.sum(F.get(sizes, F.col("c")))).first()[0] or 0

    def _meet(self, visits: DataFrame, work, kind: str) -> DataFrame:
        """``work`` (queries, members, cosines, allowed, state of its task) over strips of blocks of visiting rows and of members."""
        lit = lambda xs: F.array(*(F.lit(int(x)) for x in xs))
        seen = np.zeros(len(self.sizes), np.int64)
        for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect():
            seen[r.cell] = r.n
        start, parts = map(lit, self._deal(self.sizes))
        # Visiting rows are dealt by their own cell, so that those of one block visit few.
        own_start, own_parts = map(lit, self._deal(seen))
        block = F.get(start, F.col("cell")) + F.pmod(F.xxhash64("id"), F.get(parts, F.col("cell"))).cast("int")
        mine = F.get(own_start, F.col("cell")) + F.pmod(F.xxhash64("id", "v"), F.get(own_parts, F.col("cell"))).cast("int")
        targets = F.array_distinct(F.flatten(F.transform("visits", lambda c: F.sequence(F.get(start, c), F.get(start, c) + F.get(parts, c) - 1))))
        left = visits.withColumn("j", mine).withColumn("i", F.explode(targets))
        pairs = left.select("i", "j").distinct()  # pairs of blocks
        right = self.members.withColumn("i", block).join(F.broadcast(pairs), "i")
        sees = [F.col(c) if c in visits.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("tags", "array<string>"), ("inverse", "boolean"))]
        both = left.select("i", "j", "id", "v", "cell", "mask", *sees).unionByName(right.select("i", "j", "id", "v", "cell", F.lit(None).cast("binary").alias("mask"), F.array().cast("array<string>").alias("tags"), "tag"), allowMissingColumns=True)
        empty = pd.DataFrame({c.split()[0]: [] for c in kind.split(", ")})
        n_cells = len(self.sizes)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            q, m = pdf[pdf["mask"].notna()].sort_values("cell", kind="stable"), pdf[pdf["mask"].isna()].sort_values("id", kind="stable")
            if not len(q) or not len(m):
                return empty
            cells, ids, others = m.cell.to_numpy(), q.id.to_numpy(), m.id.to_numpy()
            x, y = np.stack(list(q.v)), np.stack(list(m.v))
            table = np.unpackbits(np.frombuffer(b"".join(q["mask"]), np.uint8).reshape(len(q), -1), axis=1)[:, :n_cells].astype(bool)
            sees = None
            if q.tags.notna().any():
                names, codes = np.unique(m.tag.fillna("").to_numpy(str), return_inverse=True)
                sees = np.array([np.full(len(names), True) if tags is None else np.isin(names, list(tags)) != bool(inverse) for tags, inverse in zip(q.tags, q.inverse)])
            out, state, step = [], {}, max(1, STRIP // len(m))
            for a in range(0, len(q), step):
                own = table[a : a + step]
                go = np.flatnonzero(own.any(axis=0)[cells])
                if not len(go):
                    continue
                allowed = own[:, cells[go]]
                if sees is not None:
                    allowed &= sees[a : a + step][:, codes[go]]
                out.append(work(ids[a : a + step], others[go], x[a : a + step] @ y[go].T, allowed, state))
            return pd.concat(out) if out else empty

        return both.groupBy("i", "j").applyInPandas(run, kind)

    def nearest(self, queries: DataFrame, k: int = 1, key: str = "vec_id", vector: str = "embedding", skip_self: bool = True, tags: str | None = None, inverse: bool = False) -> DataFrame:
        """(query, match, similarity, rank): the ``k`` nearest members of every query, exactly.

        ``tags`` is a column of arrays: a query sees members of these tags only (with ``inverse`` of all others), and all if it is null.
        """
        asked = self.located(queries, key, vector, tags, inverse)

        def work(ids: np.ndarray, others: np.ndarray, s: np.ndarray, ok: np.ndarray, state: dict) -> pd.DataFrame:
            s = np.where(ok & (ids[:, None] != others[None, :]) if skip_self else ok, s, -np.inf)
            top = np.argsort(-np.round(s, 12), axis=1, kind="stable")[:, :k]
            out = pd.DataFrame({"query": np.repeat(ids, top.shape[1]), "match": others[top].ravel(), "similarity": np.take_along_axis(s, top, axis=1).ravel()})
            return out[np.isfinite(out.similarity)]

        rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("similarity", 12)), "match"))
        best = lambda df: df.withColumn("rank", rank).where(F.col("rank") <= k)
        first = staged(best(self._meet(self.first_visits(asked, k, skip_self), work, "query long, match long, similarity double")), "near")
        more = self._meet(self.other_visits(asked, first, k, skip_self), work, "query long, match long, similarity double")
        return best(first.drop("rank").unionByName(more))

    def located(self, rows: DataFrame, key: str = "vec_id", vector: str = "embedding", tags: str | None = None, inverse: bool = False) -> DataFrame:
        sees = [] if tags is None else [F.col(tags).cast("array<string>").alias("tags"), F.lit(inverse).alias("inverse")]
        own = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), *sees)
        return staged(self._assign(own, self.pivots).drop("angle"), "located")

    def first_visits(self, asked: DataFrame, k: int, skip_self: bool = True) -> DataFrame:
        return self._visits(asked, None, k + skip_self)

    def other_visits(self, asked: DataFrame, first: DataFrame, k: int, skip_self: bool = True) -> DataFrame:
        """Cells besides the first that can hold one nearer than the k-th found there."""
        reach = first.where(F.col("rank") == k).select(F.col("query").alias("id"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "similarity"))).alias("reach"))
        return self._visits(asked.join(reach, "id", "left"), None, k + skip_self)

    def links(self, least: float, doubtful: float | None = None) -> DataFrame:
        """(id, other, n, low, doubt): a row (other -1) of each member and task with its number of others of a cosine of ``least`` or
        more, the least of them, and the number from ``doubtful`` up to that; and links, no more of them in a task than join its rows."""
        low = least if doubtful is None else min(doubtful, least)
        far = np.iinfo(np.int64).max

        def work(ids: np.ndarray, others: np.ndarray, s: np.ndarray, ok: np.ndarray, state: dict) -> pd.DataFrame:
            p, q = np.nonzero(ok & (s >= low - 1e-8))  # rounding comes to few
            s = np.round(s[p, q], 9)
            own = (ids[p] != others[q]) & (s >= low)
            p, q, s = p[own], q[own], s[own]
            hit = s >= least
            first = np.full(len(ids), far)
            np.minimum.at(first, p[hit], others[q[hit]])
            each = pd.DataFrame({"id": ids, "other": -1, "n": np.bincount(p[hit], minlength=len(ids)), "low": first, "doubt": np.bincount(p[~hit], minlength=len(ids))})
            root: dict[int, int] = state

            def find(x: int) -> int:
                while root.get(x, x) != x:
                    root[x] = root.get(root[x], root[x])
                    x = root[x]
                return x

            joins = []
            for x, y in zip(ids[p[hit]].tolist(), others[q[hit]].tolist()):
                a, b = find(x), find(y)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    joins.append((x, y, 0, far, 0))
            return pd.concat([each, pd.DataFrame(joins, columns=each.columns)]) if joins else each

        return self._meet(self.threshold_visits(low), work, "id long, other long, n long, low long, doubt long")

    def band(self, low: float, high: float, per: int) -> DataFrame:
        """(query, match, similarity, rank): for each member its ``per`` nearest of a cosine from ``low`` up to ``high``."""

        def work(ids: np.ndarray, others: np.ndarray, s: np.ndarray, ok: np.ndarray, state: dict) -> pd.DataFrame:
            s = np.round(s, 9)
            s = np.where(ok & (ids[:, None] != others[None, :]) & (s >= low) & (s < high), s, -np.inf)
            top = np.argsort(-s, axis=1, kind="stable")[:, :per]
            out = pd.DataFrame({"query": np.repeat(ids, top.shape[1]), "match": others[top].ravel(), "similarity": np.take_along_axis(s, top, axis=1).ravel()})
            return out[np.isfinite(out.similarity)]

        rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "match"))
        return self._meet(self.threshold_visits(low), work, "query long, match long, similarity double").withColumn("rank", rank).where(F.col("rank") <= per)

    def threshold_visits(self, least: float) -> DataFrame:
        return staged(self._visits(self.members.select(F.col("id").cast("long").alias("id"), "v", "cell"), least, None), "visits")
