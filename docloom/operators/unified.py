"""Search for a table of queries at once: arms, fusion, groups, exact hits on top, a threshold, and hints of what is out of scope.

Each corpus has rows (key, group, scope, text), an index of their words and one of their vectors.  Every query meets every corpus
in two arms (words and vectors) within its scopes; ranks are fused, a group keeps its best row with the flags of all its rows
or-ed, rows with a phrase or document number of the query come first, and a local score with the fusion's as a prior decides on
the rest, which are then chosen to be unlike each other (MMR).  Arms return at most a pool for each query, by a ranked limit that Spark applies before it shuffles.

An arm that fails is left out and named in ``failed``; the others answer.

Edge cases: a query without a vector has no vector arm, and one without terms and phrases no lexical one; null scopes are no
limit, an empty list allows nothing; a query without any hit has no rows; rows that share a key count as one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators.search import FLOOR, POOL, PRIOR, RERANK, RRF_K, mmr
from docloom.operators.textindex import TextIndex
from docloom.operators.vectorindex import VectorIndex
from docloom.session import staged

#: Least score, the score taken where none reaches it, and out-of-scope hints of a query.
THRESHOLD, DEGRADED, HINTS = 0.2, 0.15, 5
#: Weight of relevance against likeness to the rows before.
MMR = 0.7
#: Hits that a text is sent to at once.
HITS = 10_000


@dataclass
class Corpus:
    """``rows`` (key, group, scope, text); the vector index has the scopes as tags."""

    name: str
    rows: DataFrame
    words: TextIndex | None
    vectors: VectorIndex | None = None


@dataclass
class Found:
    """``ranked`` (query, rank, corpus, group, key, rrf, similarity, lexical, exact, score), ``hints`` (query, rank, corpus, key, similarity)."""

    ranked: DataFrame
    hints: DataFrame
    failed: list[str] = field(default_factory=list)


def _best(df: DataFrame, order: list[Column], most: int, *by: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def _words_arm(queries: DataFrame, corpus: Corpus, pool: int) -> DataFrame:
    groups = corpus.rows.groupBy("key").agg(F.min("group").alias("group"), F.min("scope").alias("scope"))
    if hasattr(corpus.words, "best_many"):
        best = corpus.words.best_many(queries, corpus.rows, pool).join(groups, "key")
    else:  # an index that plugs in may have no more than the hits
        found = corpus.words.lexical_many(queries).join(groups, "key").join(queries.select("query", "scopes"), "query").where(F.col("scopes").isNull() | F.array_contains("scopes", F.col("scope")))
        best = _best(found, [F.desc("needle"), F.desc("all_terms"), F.desc("hits"), F.desc("tf"), F.asc("key")], pool, "query")
    return best.select("query", "key", "group", "rank", F.lit(None).cast("double").alias("similarity"), F.lit(True).alias("lexical"), F.col("needle").alias("exact"))


def _alike(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ask, embedding, scopes) of what is asked of the vectors, each once, and (query, ask): questions with one vector and the same scopes share an answer."""
    own = queries.where("embedding is not null").select("query", "embedding", "scopes")
    asks = staged(own.select("embedding", "scopes").distinct().withColumn("ask", F.monotonically_increasing_id()), "asks")
    same = asks.select(F.col("embedding").alias("e"), F.col("scopes").alias("s"), "ask")
    return asks, staged(own.join(same, (own["embedding"] == same["e"]) & own["scopes"].eqNullSafe(same["s"])).select("query", "ask"), "asked")


def _nearest(alike: tuple[DataFrame, DataFrame], vectors: VectorIndex, most: int, inverse: bool = False) -> DataFrame:
    """(query, match, similarity) of the ``most`` nearest of each query, each answer searched for once."""
    asks, asked = alike
    near = vectors.nearest(asks, most, "ask", "embedding", False, "scopes", inverse)
    return asked.join(near.select(F.col("query").alias("ask"), "match", "similarity"), "ask").drop("ask")


def _vector_arm(alike: tuple[DataFrame, DataFrame], corpus: Corpus, pool: int) -> DataFrame:
    near = _best(_nearest(alike, corpus.vectors, pool), [F.desc(F.round("similarity", 12)), F.asc("match")], pool, "query")
    groups = corpus.rows.groupBy("key").agg(F.min("group").alias("group"))
    return near.join(groups, near["match"] == groups["key"]).select("query", "key", "group", "rank", "similarity", F.lit(False).alias("lexical"), F.lit(False).alias("exact"))


def _fused(arms: DataFrame) -> DataFrame:
    """(query, corpus, key, group, rrf, similarity, lexical, exact) of the rows that pass the floor, best row of each group with the flags of all its rows."""
    each = arms.groupBy("query", "corpus", "group", "key").agg(F.sum(1.0 / (F.col("rank") + F.lit(float(RRF_K)))).alias("rrf"), F.max("similarity").alias("similarity"), F.bool_or("lexical").alias("lexical"), F.bool_or("exact").alias("exact"))
    each = each.where((F.col("similarity") >= FLOOR) | F.col("lexical"))
    best = F.max_by(F.struct("key", "rrf", "similarity"), F.struct(F.round("rrf", 12), -F.col("key")))
    return each.groupBy("query", "corpus", "group").agg(best.alias("b"), F.bool_or("lexical").alias("lexical"), F.bool_or("exact").alias("exact")).select("query", "corpus", "group", "b.*", "lexical", "exact")


def _overlaps(rows: DataFrame, names: list[str]) -> DataFrame:
    """``names`` of the rows that are hits (kind 1) with the words that they share with their text, both sides' distinct words, and whether the query's
    stand there in a row.  A text's own row (kind 0) comes before its hits; ``words`` are joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, text = None, set(), ""
        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            out = []
            for kind, at, words in zip(kinds, zip(batch.column("corpus").to_pylist(), batch.column("key").to_pylist()), batch.column("words").to_pylist()):
                if kind == 0:
                    now, held, text = at, set((words or "").split()), f" {words or ''} "
                else:
                    asked = set((words or "").split())
                    both = len(asked & held) if at == now else 0
                    out.append((both, len(held) if at == now else 0, len(asked), 0 < both == len(asked) and f" {words} " in text))
            if out:
                hits = batch.filter(pa.array([k == 1 for k in kinds])).select(names)
                told = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*hits.columns, *told], names=[*names, "both", "own", "asked", "row"])

    kind = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kind}, both int, own int, asked int, row boolean")


def _scored(hits: DataFrame, texts: DataFrame, queries: DataFrame) -> DataFrame:
    """``hits`` (query, corpus, key, rrf, ...) with a score by their ``texts`` (corpus, key, text): coverage of the query's words, Jaccard, a bonus for all of them in a row, and the prior.

    A text goes to its hits, and is cut into words, once for each ``HITS`` of them.
    """
    said = lambda c: F.array_join(tx.tokens(F.col(c)), " ").alias("words")
    parts = hits.groupBy("corpus", "key").agg(F.ceil(F.count("*") / HITS).cast("int").alias("parts"))
    asked = queries.select("query", said("query_text"))
    met = hits.join(parts, ["corpus", "key"]).join(asked, "query").withColumns({"part": F.pmod(F.xxhash64("query"), F.col("parts")).cast("int"), "kind": F.lit(1)})
    own = texts.join(parts, ["corpus", "key"]).groupBy("corpus", "key").agg(F.min("text").alias("text"), F.max("parts").alias("parts"))
    own = own.select("corpus", "key", said("text"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"))
    every = met.drop("parts").unionByName(own, allowMissingColumns=True).repartition("corpus", "key", "part").sortWithinPartitions("corpus", "key", "part", "kind")
    body = _overlaps(every, hits.columns)
    local = RERANK[0] * F.col("both") / F.col("asked") + RERANK[1] * F.col("both") / (F.col("own") + F.col("asked") - F.col("both")) + F.when(F.col("row"), RERANK[2]).otherwise(0.0)
    local = F.round(F.when((F.col("asked") > 0) & (F.col("own") > 0), local).otherwise(0.0), 4)
    top = F.max("rrf").over(W.partitionBy("query"))
    return body.withColumn("score", F.round(PRIOR[0] * local + PRIOR[1] * F.col("rrf") / top, 4)).drop("both", "own", "asked", "row")


def _cut(scored: DataFrame, most: Column) -> DataFrame:
    """Rows at the threshold, by the best score of their query (``most``), with exact ones; ``sure``: whether the score decided."""
    least = F.when(most >= THRESHOLD, THRESHOLD).when(most >= DEGRADED, DEGRADED).otherwise(float("-inf"))
    return scored.withColumn("least", least).where("exact or score >= least").withColumn("sure", F.col("least") > float("-inf")).drop("least")


def _diversified(scored: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query, with rank: exact rows first, as they were found; then the others that are relevant and unlike those before
    them.  The threshold looks at these alone; where it is sure of none they stay as they were found."""
    kept = _cut(scored, F.max(F.when(~F.col("exact"), F.col("score"))).over(W.partitionBy("query")))
    own = F.when(~F.col("exact") & F.col("sure"), F.col("score"))
    order = W.partitionBy("query").orderBy(F.desc("exact"), F.desc(own), F.desc(F.round("rrf", 12)), F.asc("corpus"), F.asc("key"))
    placed = staged(kept.withColumns({"rank": F.row_number().over(order), "pinned": F.count_if("exact").over(W.partitionBy("query"))}), "placed")
    open_ = F.col("sure") & ~F.col("exact") & (F.col("pinned") < k)
    met = placed.where(open_).join(texts.groupBy("corpus", "key").agg(F.min("text").alias("text")), ["corpus", "key"], "left")
    # Places are in the order of scores, so they break its ties; all of a query's rows are looked at.
    told = mmr(met, k, MMR, "query", "rank", "text", "score", 2 * k)
    told = told.withColumn("rank", (F.col("pinned") + F.col("mmr_rank")).cast("int")).select(placed.columns)
    return placed.where(~F.col("sure") | F.col("exact")).unionByName(told).where(F.col("rank") <= k)


def _arm(failed: list[str] | None, name: str, make: Callable[[], DataFrame]) -> list[DataFrame]:
    """The rows of an arm, or none if it fails and there is a list to name it in."""
    try:
        return [staged(make(), "arm")]  # computed here, so that an arm's error is its own
    except Exception as e:  # noqa: BLE001  (what a plug-in index may raise is open)
        if failed is None:
            raise
        failed.append(f"{name}: {type(e).__name__}")
        return []


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def out_of_scope(queries: DataFrame, corpora: list[Corpus], failed: list[str] | None = None) -> DataFrame:
    """(query, rank, corpus, key, similarity): the rows most like each query among those that its scopes hide.

    A corpus whose search fails is named in ``failed`` and left out; without that list its error is raised.
    """
    alike = _alike(queries.where("scopes is not null"))
    hints = []
    for c in corpora:
        if c.vectors is not None:
            found = _arm(failed, f"{c.name} out of scope", lambda c=c: _nearest(alike, c.vectors, HINTS, inverse=True))
            hints += [h.withColumn("corpus", F.lit(c.name)) for h in found]
    hints = hints or [queries.sparkSession.createDataFrame([], "query long, match long, similarity double, corpus string")]
    told = _best(_union(hints), [F.desc(F.round("similarity", 12)), F.asc("corpus"), F.asc("match")], HINTS, "query")
    return told.select("query", "rank", "corpus", F.col("match").alias("key"), "similarity")


def search_all(queries: DataFrame, corpora: list[Corpus], k: int = 10, pool: int = POOL, diverse: bool = True) -> Found:
    """``queries``: (query, query_text, terms, phrases, embedding, scopes).  The ``k`` best rows of each over all corpora.

    Without ``diverse`` rows are in the order of their scores alone, near copies beside each other, exact ones too.
    """
    queries = staged(queries.select("query", "query_text", "terms", "phrases", "embedding", "scopes"), "queries")
    failed: list[str] = []
    alike = _alike(queries)
    arms = []
    for c in corpora:
        own = _arm(failed, f"{c.name} words", lambda c=c: _words_arm(queries, c, pool))
        if c.vectors is not None:
            own += _arm(failed, f"{c.name} vectors", lambda c=c: _vector_arm(alike, c, pool))
        arms += [a.withColumn("corpus", F.lit(c.name)) for a in own]
    arms = arms or [queries.sparkSession.createDataFrame([], "query long, key long, group string, rank int, similarity double, lexical boolean, exact boolean, corpus string")]
    hints = out_of_scope(queries, corpora, failed)
    # Twice as many as are asked for are scored; exact ones are always among them.
    order = [F.desc("exact"), F.desc(F.round("rrf", 12)), F.asc("corpus"), F.asc("key")]
    hits = staged(_best(_fused(_union(arms)), order, 2 * k, "query").drop("rank"), "hits")
    texts = _union([c.rows.select("key", "text", F.lit(c.name).alias("corpus")) for c in corpora])
    scored = staged(_scored(hits, texts, queries), "scored")
    if diverse:
        wanted = texts.join(hits.select("corpus", "key").distinct(), ["corpus", "key"], "left_semi")
        ranked = staged(_diversified(scored, wanted, k), "ranked")
    else:
        kept = _cut(scored, F.max("score").over(W.partitionBy("query")))
        ranked = _best(kept, [F.desc("exact"), F.desc("score"), F.desc(F.round("rrf", 12)), F.asc("corpus"), F.asc("key")], k, "query")
    return Found(ranked.select("query", "rank", "corpus", "group", "key", "rrf", "similarity", "lexical", "exact", "score"), hints, failed)
