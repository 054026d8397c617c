"""Hybrid retrieval: exact vector search, lexical search, rank fusion, reranking and diversification."""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as tx
from docloom.functions import vectors as vec
from docloom.operators.consolidate import clusters
from docloom.operators.vectorindex import VectorIndex
from docloom.session import staged

#: Rank constant of the fusion, rows from each arm, least cosine and coverage, weights of the local rerank and of the prior.
RRF_K, POOL, FLOOR, STRONG = 60, 50, 0.35, 0.6
RERANK, PRIOR = (0.5, 0.2, 0.3), (0.6, 0.4)


def nearest(corpus: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows of most cosine with one query vector, which comes as a constant; ties by key."""
    return corpus.select(F.col("*"), vec.cosine(F.col(vector), vec.constant(query)).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def best_per_group(hits: DataFrame, group: str, score: str, key: str) -> DataFrame:
    """One row of each group: the best score, then the least key."""
    best = F.max_by(F.struct("*"), F.struct(F.col(score), -F.col(key)))
    return hits.groupBy(group).agg(best.alias("hit")).select("hit.*")


def knn_join(queries: DataFrame, corpus: DataFrame, k: int = 1, key: str = "vec_id", vector: str = "embedding", skip_self: bool = True) -> DataFrame:
    """(query, match, similarity, rank): the ``k`` nearest of ``corpus`` for every query, exactly, by an index of the corpus."""
    return VectorIndex.build(corpus, key, vector).nearest(queries, k, key, vector, skip_self)


def similarity_classes(corpus: DataFrame, least: float, doubtful: float | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster, n_links, least_link, n_doubtful): each row's class, that of all rows that links reach, with its least key;
    how many others have a cosine of ``least`` or more; the least key among them; and how many are from ``doubtful`` up to that.

    Rows meet those of the cells that their bounds allow.  A task returns a row for each that visits, and of its links no more
    than join its rows, which is all that classes need; pairs never leave it.  Rows without a vector are alone.
    """
    found = staged(VectorIndex.build(corpus, key, vector).links(least, doubtful), "links")
    counts = found.where("other < 0").groupBy("id").agg(F.sum("n").alias("n_links"), F.min(F.when(F.col("n") > 0, F.col("low"))).alias("least_link"), F.sum("doubt").alias("n_doubtful"))
    classes = clusters(corpus.select(F.col(key).alias("id")).distinct(), found.where("other >= 0").select(F.col("id").alias("a"), F.col("other").alias("b")))
    out = classes.join(counts, "id", "left").select(F.col("id").alias(key), "cluster", F.coalesce("n_links", F.lit(0)).alias("n_links"), "least_link", F.coalesce("n_doubtful", F.lit(0)).alias("n_doubtful"))
    return out if doubtful is not None else out.drop("n_doubtful")


#: Cosines from which concepts are one, from which that is doubtful, and from which pages may contradict each other.
SURE, DOUBTFUL, NEIGHBOURS = 0.9, 0.75, 0.8


def doubtful_pairs(index: VectorIndex, low: float = DOUBTFUL, sure: float = SURE, per: int = 3) -> DataFrame:
    """(a, b, similarity), a < b, each once: what a model should judge, a bounded number for each concept."""
    near = index.band(low, sure, per)
    return near.groupBy(F.least("query", "match").alias("a"), F.greatest("query", "match").alias("b")).agg(F.max("similarity").alias("similarity"))


def judged(pairs: DataFrame, texts: DataFrame, model, key: str = "vec_id", text: str = "text") -> DataFrame:
    """(a, b, verdict) by a pluggable model: a function from two lists of texts to a list of answers."""
    of = lambda side: texts.select(F.col(key).alias(side), F.col(text).alias(f"{side}_text"))

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"a": pdf.a, "b": pdf.b, "verdict": model(pdf.a_text.tolist(), pdf.b_text.tolist())})

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_text", "b_text").mapInPandas(run, "a long, b long, verdict boolean")


def resolve_ambiguous(index: VectorIndex, verdicts: DataFrame, sure: float = SURE) -> DataFrame:
    """(id, cluster, contested) of all members: sure links and pairs that are judged the same (a, b, verdict) join.

    Where that joins a pair which is judged to differ, the class is contested, and its members keep to their sure links.
    """
    verdicts = staged(verdicts.select("a", "b", "verdict"), "verdicts")
    links = staged(index.links(sure).where("other >= 0").select(F.col("id").alias("a"), F.col("other").alias("b")), "sure")
    nodes = index.members.select("id").distinct()
    joined = staged(clusters(nodes, links.unionByName(verdicts.where("verdict").select("a", "b"))), "joined")
    side = lambda name: joined.select(F.col("id").alias(name), F.col("cluster").alias(f"c{name}"))
    apart = verdicts.where("not verdict").join(side("a"), "a").join(side("b"), "b").where("ca = cb").select(F.col("ca").alias("cluster")).distinct().withColumn("contested", F.lit(True))
    marked = staged(joined.join(apart, "cluster", "left").select("id", "cluster", F.coalesce("contested", F.lit(False)).alias("contested")), "marked")
    alone = clusters(marked.where("contested").select("id"), links.join(marked.where("contested").select(F.col("id").alias("a")), "a", "left_semi"))
    return marked.where("not contested").unionByName(alone.withColumn("contested", F.lit(True)))


def conflict_candidates(drafts: DataFrame, pages: DataFrame, most: int = 5, least: float = NEIGHBOURS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(a, b, similarity): for each draft the neighbours that it may contradict, for ``judged``."""
    near = VectorIndex.build(pages, key, vector).nearest(drafts, most, key, vector)
    return near.where(F.col("similarity") >= least).select(F.col("query").alias("a"), F.col("match").alias("b"), "similarity")


def similar_links(corpus: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, least_link) of ``similarity_classes``."""
    return similarity_classes(corpus, least, None, key, vector).drop("cluster")


def rrf(arms: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """(key, rrf): the sum of 1 / (k + rank) over the arms (key, rank)."""
    both = arms[0].select(key, "rank")
    for arm in arms[1:]:
        both = both.unionByName(arm.select(key, "rank"))
    return both.groupBy(key).agg(F.sum(F.lit(1.0) / (F.col("rank") + F.lit(k))).alias("rrf"))


def ranked(df: DataFrame, order: list[Column], pool: int = POOL) -> DataFrame:
    """The first ``pool`` rows with their ranks; only they reach the window."""
    return df.orderBy(*order).limit(pool).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def lexical(docs: DataFrame, terms: list[str], phrases: list[str] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hits, all_terms, needle, tf): rows with a phrase or any of the folded terms, and what they are ordered by."""
    needle = F.lit(False)
    for p in phrases:
        needle = needle | F.contains(tx.fold_lower(F.col(text)), F.lit(p))
    found = docs.select(key, tx.term_hits(F.col(text), terms).alias("found"), F.coalesce(needle, F.lit(False)).alias("needle"))
    scored = found.select(key, F.size(F.array_distinct("found")).alias("hits"), F.size("found").alias("tf"), "needle")
    return scored.where("hits > 0 or needle").withColumn("all_terms", F.col("hits") == len(set(terms)))


def lexical_order(key: str = "doc_id") -> list[Column]:
    return [F.desc("needle"), F.desc("all_terms"), F.desc("hits"), F.desc("tf"), F.asc(key)]


def bm25(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, bm25) of rows with any term.  Texts are read once, into a narrow table of sizes and counts; statistics (a row) and scores come from that."""
    found = docs.select(key, tx.n_tokens(F.col(text)).alias("size"), tx.term_hits(F.col(text), terms).alias("found"))
    count = lambda t: F.size(F.filter("found", lambda w: w == t))
    counted = staged(found.select(key, F.coalesce("size", F.lit(0)).alias("size"), *(F.when(F.size("found") > 0, count(t)).otherwise(0).alias(f"t{i}") for i, t in enumerate(terms))), "counts")
    stats = counted.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *(F.sum((F.col(f"t{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(terms)))).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        d = stats[f"d{i}"] or 0
        idf = float(np.log(1 + ((stats.n or 0) - d + 0.5) / (d + 0.5)))
        tf = F.col(f"t{i}").cast("double")
        score = score + F.when(tf > 0, idf * tf / (tf + k1 * (1 - b + b * F.col("size") / float(stats.mean or 1)))).otherwise(0.0)
    return counted.select(key, score.alias("bm25")).where("bm25 > 0")


def hybrid(vectors: DataFrame, found: DataFrame, query: list[float], k: int = 10, floor: float = FLOOR, key: str = "doc_id") -> DataFrame:
    """(key, rrf, similarity, lexical): vector and lexical arms fused; a row needs the least cosine or a lexical hit.

    ``found`` are rows of ``lexical``, from texts or from an index.
    """
    near = nearest(vectors, query, POOL, key)
    arm = near.select(key, F.row_number().over(W.orderBy(F.desc("similarity"), key)).alias("rank"), "similarity", F.lit(False).alias("lexical"))
    words = ranked(found, lexical_order(key)).select(key, "rank", F.lit(None).cast("double").alias("similarity"), F.lit(True).alias("lexical"))
    score = F.sum(F.lit(1.0) / (F.col("rank") + F.lit(RRF_K)))
    fused = arm.unionByName(words).groupBy(key).agg(score.alias("rrf"), F.max("similarity").alias("similarity"), F.bool_or("lexical").alias("lexical"))
    return fused.where((F.col("similarity") >= floor) | F.col("lexical")).orderBy(F.desc("rrf"), key).limit(k)


def local_rerank(hits: DataFrame, query: str, text: str = "text", prior: str | None = None) -> DataFrame:
    """``hits`` with rerank_score: coverage, Jaccard and a bonus for the phrase, blended with a prior if one is given."""
    words = tx.words_of(query)
    q = list(dict.fromkeys(words))
    if not q:
        out = hits.withColumn("rerank_score", F.lit(0.0))
    else:
        folded = hits.withColumn("__text", tx.fold_lower(F.col(text)))
        marked = folded.withColumn("__own", F.array_distinct(tx.words_in(F.col("__text")))).withColumn("__both", F.size(F.array_intersect(F.array(*map(F.lit, q)), "__own"))).withColumn("__n", F.size("__own"))
        both, phrase = F.col("__both"), F.rlike("__text", F.lit(tx.phrase_pattern(words)))
        score = RERANK[0] * both / len(q) + RERANK[1] * both / (F.col("__n") + len(q) - both) + F.when(phrase, RERANK[2]).otherwise(0.0)
        out = marked.withColumn("rerank_score", F.round(F.when(F.col("__n") > 0, score).otherwise(0.0), 4)).drop("__text", "__own", "__both", "__n")
    if prior:
        top = hits.agg(F.max(prior).alias("__top"))  # one row, met by every hit
        share = F.when(F.col("__top") > 0, PRIOR[1] * F.col(prior) / F.col("__top"))
        out = out.join(F.broadcast(top), F.col(prior) <= F.col("__top"), "left").withColumn("rerank_score", F.round(PRIOR[0] * F.col("rerank_score") + F.coalesce(share, F.lit(0.0)), 4)).drop("__top")
    return out


def pass_threshold(hits: DataFrame, score: str = "rerank_score", least: float = 0.2, floor: float = 0.15) -> DataFrame:
    """Rows at the threshold; if none is, at the floor; if none is, all.  The best score, one row, says which."""
    best = F.max(score)
    cut = hits.agg(F.when(best >= least, least).when(best >= floor, floor).otherwise(F.lit(float("-inf"))).alias("__cut"))
    return hits.join(F.broadcast(cut), F.col(score) >= F.col("__cut"), "left_semi")


def mmr(hits: DataFrame, k: int = 10, weight: float = 0.7, group: str = "query", key: str = "doc_id", text: str = "text", score: str = "rerank_score", pool: int = 100) -> DataFrame:
    """The ``k`` rows of each query that are relevant and unlike those before them, of its best ``pool``; mmr_rank from 1."""
    best = F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), key))
    rows = hits.withColumn("__r", best).where(F.col("__r") <= pool).select(*hits.columns, tx.tokens(F.col(text)).alias("__words"))
    names = hits.columns
    schema = T.StructType([*hits.schema.fields, T.StructField("mmr_rank", T.IntegerType())])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, key], ascending=[False, True]).reset_index(drop=True)
        words, near = [set(w) for w in pdf["__words"]], np.zeros(len(pdf))
        left, chosen = list(range(len(pdf))), []
        while left and len(chosen) < k:
            i = left[0] if not chosen else max(left, key=lambda i: (weight * pdf[score][i] - (1 - weight) * near[i], -i))
            chosen.append(i)
            left.remove(i)
            for j in left:
                union = len(words[i] | words[j])
                near[j] = max(near[j], len(words[i] & words[j]) / union if words[i] and words[j] else 0.0)
        out = pdf.loc[chosen, names].copy()
        out["mmr_rank"] = np.arange(1, len(chosen) + 1, dtype=np.int32)
        return out

    return rows.groupBy(group).applyInPandas(pick, schema)


def expand_neighbours(hits: DataFrame, units: DataFrame, relations: DataFrame, per_node: int = 5, nodes: int = 5) -> DataFrame:
    """One step along relations (source_unit, target_unit, relation_type) from hit units, either way, each neighbour once."""
    start = hits.orderBy(*(["rank"] if "rank" in hits.columns else []), "unit_id").select("unit_id").limit(nodes)
    out = relations.join(start, relations["source_unit"] == start["unit_id"]).select(F.col("target_unit").alias("unit_id"), "relation_type", F.lit("out").alias("direction"))
    into = relations.join(start, relations["target_unit"] == start["unit_id"]).select(F.col("source_unit").alias("unit_id"), "relation_type", F.lit("in").alias("direction"))
    return out.unionByName(into).dropDuplicates().join(units, "unit_id", "left").orderBy("unit_id", "relation_type", "direction").limit(per_node * nodes * 2)


def expand_by_citation(hits: DataFrame, units: DataFrame, relations: DataFrame, per_node: int = 5, nodes: int = 5) -> DataFrame:
    """One step from hit units along what they cite and what cites them, by document number and article where no unit was linked.

    ``units`` has (unit_id, doc_number, unit_number), ``relations`` (source_unit, target_number, target_article, relation_type).
    """
    norm = lambda name: F.upper(F.trim(F.col(name)))
    named = units.select(F.col("unit_id").alias("target_unit"), norm("doc_number").alias("__n"), F.lower("unit_number").alias("__a")).groupBy("__n", "__a").agg(F.min("target_unit").alias("target_unit"))
    linked = relations.select("source_unit", "relation_type", norm("target_number").alias("__n"), F.lower("target_article").alias("__a")).join(named, ["__n", "__a"]).select("source_unit", "target_unit", "relation_type")
    return expand_neighbours(hits, units, linked, per_node, nodes)


def route(units: DataFrame, number: str, article: str) -> DataFrame:
    """The unit of a document number and article: an exact number first, then one that begins so, then one that has it."""
    own = F.upper(F.regexp_replace(tx.fold(tx.plain_dashes(F.col("doc_number"))), r"\s", ""))
    step = F.when(own == number, 0).when(F.startswith(own, F.lit(number)), 1).when(F.contains(own, F.lit(number)), 2)
    return units.withColumn("step", step).where(F.col("step").isNotNull() & (F.lower("unit_number") == article.lower())).orderBy("step", "unit_id").limit(1)



def content_search(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", k: int = 20) -> DataFrame:
    """(key, step, hits): rows with all terms; where there are none, rows with any; where there are none, rows that contain one of
    the first three longer terms.  One pass marks all three; the rows of the least step come first, so it is among the first ``k``.
    """
    longer = [t for t in terms if len(t) > 2][:3]
    asked = list(dict.fromkeys(terms))
    word = lambda x, t: F.when(F.contains(x, F.lit(t)), F.rlike(x, F.lit(rf"(?<![\p{{L}}\p{{N}}_]){re.escape(t)}(?![\p{{L}}\p{{N}}_])"))).otherwise(False).cast("int")

    def mark(x: Column) -> Column:
        part = functools.reduce(lambda a, b: a | b, (F.contains(x, F.lit(t)) for t in longer), F.lit(False))
        return F.when(x.isNotNull(), F.struct(sum((word(x, t) for t in asked if re.fullmatch(r"\w+", t)), F.lit(0)).alias("hits"), part.alias("part")))

    marked = docs.select(key, tx.let(tx.fold_lower(F.col(text)), mark).alias("m")).select(key, "m.hits", "m.part")
    step = F.when(F.col("hits") == len(asked), 1).when(F.col("hits") > 0, 2).when(F.col("part"), 3)
    best = marked.select(key, step.alias("step"), "hits").orderBy(F.asc_nulls_last("step"), F.desc("hits"), key).limit(k)
    least = F.min("step").over(W.partitionBy(F.lit(0)))  # of k rows
    return best.withColumn("least", least).where("step = least").orderBy(F.desc("hits"), key).select(key, "step", "hits")


#: From what cosine on a new page repeats an existing one, and how many of those are named.
REPEATS, REPEATS_NAMED = 0.85, 5


def semantic_duplicates(drafts: DataFrame, pages: DataFrame) -> DataFrame:
    """(query, match, similarity, rank): for each draft (vec_id, embedding) the pages most like it, five at most, of a cosine of 0.85 or more."""
    return knn_join(drafts, pages, REPEATS_NAMED).where(F.col("similarity") >= REPEATS)
