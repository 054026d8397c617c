"""From extracted items to one set of concepts: exact and near merging, relations, evidence, coverage and citations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.session import staged

#: Weights of containment and Jaccard for a claim, and its least score; the least for a page.
CLAIM, CLAIM_LEAST, PAGE_LEAST = (0.75, 0.25), 0.65, 0.85
#: The score of a claim that cites an article, or a document number, that its source lacks; how both are cited; a
#: footnote's mark, and words of sentences that say what must be.
ARTICLE_MISSING, NUMBER_MISSING = 0.2, 0.25
ARTICLE_CITED = r"(?iU)\bĐiều\s+(\d+[a-z]?)\b"
NUMBER_CITED = r"\b(\d+(?:/\d{4})?/[A-Za-z0-9/_ĐđÀ-ỹ-]+)"
MARK = r"\[\^[a-zA-Z0-9_-]+\]"
NORMATIVE = ["quy định", "phải", "nghiêm cấm", "thời hạn", "mức phạt", "điều", "khoản"]


def merge_concepts(items: DataFrame, term: str, definition: str, at: str) -> DataFrame:
    """Per normalised term: its most frequent spelling (the first of equals), the longest definition (the first), mentions and places.

    Spellings are counted before they meet, so a term that is everywhere brings one row for each spelling.
    """
    keyed = items.select(tx.concept_key(F.col(term)).alias("concept"), F.col(term).alias("spelling"), F.col(definition).alias("definition"), F.col(at).alias("at")).where("concept != ''")
    spelled = keyed.groupBy("concept", "spelling").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max_by("definition", F.struct(F.length("definition"), -F.col("at"))).alias("definition"), F.max(F.struct(F.length("definition").alias("l"), (-F.col("at")).alias("a"))).alias("d"))
    return spelled.groupBy("concept").agg(
        F.max_by("spelling", F.struct("n", -F.col("first"))).alias("spelling"), F.max_by("definition", "d").alias("definition"), F.sum("n").alias("mentions"), F.min("first").alias("first_at")
    )


def merge_relations(items: DataFrame, source: str, target: str, kind: str, evidence: str, at: str) -> DataFrame:
    """Per (source, target, predicate), case aside: weight, longest evidence and first spellings."""
    p = tx.predicate(F.col(kind))
    return items.groupBy(F.lower(source).alias("source_key"), F.lower(target).alias("target_key"), p.alias("predicate")).agg(
        F.count("*").alias("weight"), F.max_by(evidence, F.struct(F.length(evidence), -F.col(at))).alias("evidence"), F.min_by(source, at).alias("source"), F.min_by(target, at).alias("target")
    )


def clusters(nodes: DataFrame, pairs: DataFrame, node: str = "id") -> DataFrame:
    """(node, cluster): the least node that pairs (a, b) reach.  Each round passes labels on and shortens their paths."""
    both = staged(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), "pairs")
    labels = nodes.select(F.col(node).alias("n"), F.col(node).alias("l"))
    labels = staged(labels, "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["n"]).groupBy("a").agg(F.min("l").alias("m"))
        nearer = labels.join(heard, labels["n"] == heard["a"], "left").select("n", F.least("l", F.coalesce("m", "l")).alias("l"))
        up = nearer.select(F.col("n").alias("l"), F.col("l").alias("top"))
        after = staged(nearer.join(up, "l", "left").select("n", F.coalesce("top", "l").alias("l")), "labels")
        if after.join(labels.withColumnRenamed("l", "was"), "n").where("l != was").isEmpty():
            return after.select(F.col("n").alias(node), F.col("l").alias("cluster"))
        labels = after


def covered(claims: DataFrame, terms: DataFrame, least: int = 3) -> DataFrame:
    """(term, n): terms that claims mention ``least`` times or more and no page covers; terms has (term, covered)."""
    n = claims.groupBy(F.lower("term").alias("term")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.join(terms.where("covered").select(F.lower("term").alias("term")), "term", "left_anti")


def cited(c: Column, pattern: str) -> Column:
    """The articles or numbers that a text cites, folded, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(1)), lambda x: F.lower(x)))


def source_windows(text: Column) -> Column:
    """Words of paragraphs of over 20 characters and of pairs of sentences that follow each other, of over 15 each; of lone sentences where there is neither."""
    trimmed = lambda pattern, least: F.filter(F.transform(F.split(text, pattern), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: F.length(p) > least)

    def made(x: Column) -> Column:
        pairs = F.filter(F.transform(x["s"], lambda s, i: F.concat(s, F.lit(". "), F.get(x["s"], i + 1))), lambda s: s.isNotNull())
        return F.struct(F.concat(x["p"], pairs).alias("made"), x["s"].alias("s"))

    both = tx.let(F.struct(trimmed(r"\n\n", 20).alias("p"), trimmed(r"[.\n;]+", 15).alias("s")), made)
    return F.transform(tx.let(both, lambda x: F.array_distinct(F.when(F.size(x["made"]) > 0, x["made"]).otherwise(x["s"]))), tx.distinct_tokens)


def verify_claims(claims: DataFrame, docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(claim_id, score, reason, holds) of ``claims`` (claim_id, doc, claim), each against its own document.

    In this order: an empty claim holds; without a source nothing does; an article, then a document number that the source does not
    cite decides against; words for words decides for; else the best window's share of the claim's words counts, with Jaccard.
    """
    c = F.col
    flat = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    sources = docs.select(doc, flat(c(text)).alias("__plain"), cited(c(text), ARTICLE_CITED).alias("__articles"), cited(c(text), NUMBER_CITED).alias("__numbers"), source_windows(c(text)).alias("__windows"))
    own = claims.select("claim_id", doc, flat(c("claim")).alias("__claim"), cited(c("claim"), ARTICLE_CITED).alias("__a"), cited(c("claim"), NUMBER_CITED).alias("__n"))
    own = own.withColumn("__words", F.filter(tx.distinct_tokens(c("__claim")), lambda w: F.length(w) > 1))
    both = lambda w: F.size(F.array_intersect("__words", w))
    likeness = lambda w: tx.let(both(w), lambda n: CLAIM[0] * n / F.size("__words") + CLAIM[1] * n / (F.size("__words") + F.size(w) - n))
    best = F.coalesce(F.array_max(F.transform("__windows", likeness)), F.lit(0.0))
    cases = [
        (F.coalesce(c("__claim"), F.lit("")) == "", F.lit(1.0), "empty"), (F.coalesce(c("__plain"), F.lit("")) == "", F.lit(0.0), "no source"),
        (F.size(F.array_except("__a", "__articles")) > 0, F.lit(ARTICLE_MISSING), "article missing"), (F.size(F.array_except("__n", "__numbers")) > 0, F.lit(NUMBER_MISSING), "number missing"),
        (F.contains("__plain", "__claim"), F.lit(1.0), "verbatim"), (F.size("__words") == 0, F.lit(1.0), "trivial"),
    ]
    score, reason = F.round(best, 6), F.lit("overlap")
    for test, value, why in reversed(cases):
        score, reason = F.when(test, value).otherwise(score), F.when(test, F.lit(why)).otherwise(reason)
    met = own.join(sources, doc, "left").select("claim_id", score.alias("score"), reason.alias("reason"))
    return met.groupBy("claim_id").agg(F.max(F.struct("score", "reason")).alias("m")).select("claim_id", "m.score", "m.reason", (c("m.score") >= CLAIM_LEAST).alias("holds"))


def page_claims(content: Column) -> Column:
    """What a page claims: sentences with a footnote's mark, without it; where there are none, sentences that say what must be."""
    lines = F.transform(F.split(content, "\n"), lambda x: F.trim(x))
    prose = F.filter(lines, lambda x: (x != "") & ~F.rlike(x, F.lit(r"^[#>|]")))
    cut = lambda xs: F.flatten(F.transform(xs, lambda x: F.split(x, r"[.!?]+")))
    marked = F.filter(cut(F.filter(prose, lambda x: ~F.rlike(x, F.lit(r"^```|^\[\^[\w-]+\]:")))), lambda s: F.rlike(s, F.lit(MARK)))
    marked = F.filter(F.transform(marked, lambda s: F.trim(F.regexp_replace(s, MARK, ""))), lambda s: F.length(s) > 15)
    norms = F.filter(F.transform(cut(prose), lambda s: F.trim(s)), lambda s: (F.length(s) > 30) & F.rlike(F.lower(s), F.lit("|".join(NORMATIVE))))
    return F.array_distinct(F.when(F.size(marked) > 0, marked).otherwise(norms))


def verify_pages(pages: DataFrame, docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(page, n_claims, n_held, score, flagged) of ``pages`` (page, doc, content): the share of its claims that hold; flagged under 0.85."""
    each = pages.select("page", doc, F.explode(page_claims(F.col("content"))).alias("claim")).withColumn("claim_id", F.struct("page", F.lower(F.trim("claim")).alias("c")))
    held = verify_claims(each, docs, doc, text).groupBy("claim_id.page").agg(F.count("*").alias("n_claims"), F.count_if("holds").alias("n_held"))
    score = F.coalesce(F.round(F.col("n_held") / F.col("n_claims"), 6), F.lit(1.0))
    return pages.select("page").distinct().join(held, "page", "left").select("page", F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.coalesce("n_held", F.lit(0)).alias("n_held"), score.alias("score"), (score < PAGE_LEAST).alias("flagged"))


#: Opening of the block that warns of claims without ground, its second line, and how many it shows, how long.
WARNING = "> [!warning] **Cảnh báo trích dẫn"
WARNING_REST = (": Phát hiện nội dung chưa xác minh (", " khẳng định)**\n> Các nội dung sau chưa tìm thấy căn cứ trực tiếp trong tài liệu nguồn:\n")
SHOWN, SHOWN_LENGTH = 5, 120


def with_warning(content: Column, claims: Column) -> Column:
    """A page below a block that lists its claims (array) that do not hold; as it is where there are none, or where it has such a block."""
    short = lambda x: F.when(F.length(x) > SHOWN_LENGTH, F.concat(F.substring(x, 1, SHOWN_LENGTH - 3), F.lit("…"))).otherwise(x)
    lines = F.transform(F.slice(claims, 1, SHOWN), lambda x: F.concat(F.lit("> - "), short(F.replace(F.trim(x), F.lit("\n"), F.lit(" ")))))
    block = F.concat(F.lit(WARNING + WARNING_REST[0]), F.size(claims).cast("string"), F.lit(WARNING_REST[1]), F.array_join(lines, "\n"), F.lit("\n\n"))
    return F.when((F.size(claims) > 0) & ~F.contains(content, F.lit(WARNING)), F.concat(block, content)).otherwise(content)


def shared_words(claims: DataFrame, docs: DataFrame, claim: str, doc: str, text: str, least: int) -> DataFrame:
    """(claim_id, doc, n_shared): documents with ``least`` or more of a claim's distinct words.

    Of a claim's n words, one of any n - least + 1 must be shared, so only its so many rarest ones are joined, and counted there;
    its least - 1 most common words meet the documents that were found so as arrays, and are no keys.
    """
    said = claims.select("claim_id", F.explode(tx.distinct_tokens(F.col(claim))).alias("w"))
    heard = staged(docs.select(doc, F.explode(tx.distinct_tokens(F.col(text))).alias("w")).join(said.select("w").distinct(), "w", "left_semi"), "words")
    known = said.join(heard.groupBy("w").agg(F.count("*").alias("df")), "w")
    sized = known.withColumn("n", F.count("*").over(W.partitionBy("claim_id"))).withColumn("r", F.row_number().over(W.partitionBy("claim_id").orderBy("df", "w")))
    sized = staged(sized.select("claim_id", "w", (F.col("r") <= F.col("n") - least + 1).alias("rare")), "claims")
    found = sized.where("rare").join(heard, "w").groupBy("claim_id", doc).agg(F.count("*").alias("n_rare"))
    common = sized.where("not rare")
    mine = common.groupBy("claim_id").agg(F.collect_list("w").alias("cw"))
    theirs = heard.join(common.select("w").distinct(), "w", "left_semi").groupBy(doc).agg(F.collect_list("w").alias("dw"))
    shared = F.col("n_rare") + F.coalesce(F.size(F.array_intersect("cw", "dw")), F.lit(0))
    return found.join(theirs, doc, "left").join(mine, "claim_id", "left").select("claim_id", doc, shared.alias("n_shared")).where(F.col("n_shared") >= least)


#: Characters of evidence that a claim shows at most, and where it gives no length.
EXCERPT, EXCERPT_USUAL = 2000, 200


def assemble_evidence(items: DataFrame, claims: DataFrame, docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(item, claim_id, doc, excerpt): claims about one of an item's names, each with its place in its document, 2,000 characters at most.

    ``items`` (item, name), ``claims`` (claim_id, doc, subject, offset, length).  A name is met where it stands in the subject as
    whole words, case and accents aside: runs of the subject's words, no longer than the longest name, are joined with names.
    """
    c = F.col
    words = lambda name: tx.tokens(F.coalesce(c(name), F.lit("")))
    named = items.select("item", words("name").alias("w")).where(F.size("w") > 0).select("item", F.array_join("w", " ").alias("run"), F.size("w").alias("n")).distinct()
    longest = named.agg(F.max("n")).first()[0] or 0
    said = claims.select("claim_id", doc, "offset", "length", words("subject").alias("w"))
    runs = F.flatten(F.transform("w", lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - i)), lambda n: F.array_join(F.slice("w", i + 1, n), " "))))
    about = said.where(F.size("w") > 0).select("claim_id", doc, "offset", "length", F.explode(F.array_distinct(runs)).alias("run")) if longest else said.select("claim_id", doc, "offset", "length", F.lit("").alias("run"))
    met = about.join(named, "run").select("item", "claim_id", doc, "offset", "length").distinct()
    size = F.least(F.coalesce("length", F.lit(EXCERPT_USUAL)), F.lit(EXCERPT)).cast("int")
    return met.join(docs.select(doc, c(text).alias("__text")), doc, "left").select("item", "claim_id", doc, F.coalesce(F.substring(c("__text"), c("offset").cast("int") + 1, size), F.lit("")).alias("excerpt"))


def _running(rows: DataFrame, group: str, order: list[str], size: str, name: str, kind: str, start: Callable[[], dict], step: Callable[[dict, float], object]) -> DataFrame:
    """``rows`` with a column that depends on the rows before in a group's order.

    A group's rows stand together, sorted, in one partition and are read as they come: only the state of one group is kept, so a
    group may be of any length, and many small ones cost no call each.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, start()
        for pdf in frames:
            out = []
            for key, n in zip(pdf[group], pdf[size]):
                key = None if pd.isna(key) else key  # rows without a group are one group
                if now is None or key != now[0]:
                    now, state = (key,), start()
                out.append(step(state, n))
            yield pdf.assign(**{name: out})

    dealt = rows.repartition(group).sortWithinPartitions(group, *order)
    return dealt.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", {name} {kind}")


def greedy_fill(sections: DataFrame, budget: int, doc: str = "doc_id", size: str = "size", tier: str = "tier", order: str = "idx") -> DataFrame:
    """``sections`` with taken: in order of tier and place, each that still fits; one that does not fit is passed over."""

    def fill(state: dict, n: float) -> bool:
        fits = bool(n <= state["left"])
        state["left"] -= n if fits else 0
        return fits

    return _running(sections, doc, [tier, order], size, "taken", "boolean", lambda: {"left": budget}, fill)


def section_tiers(sections: DataFrame, hits: DataFrame, doc: str = "doc_id", near: int = 5000) -> DataFrame:
    """``sections`` (doc, idx, start, end) with tier A (a hit inside), B (beside one of A, or a hit near) or C, for hits (doc, pos)."""
    inside = sections.join(hits, doc).where("pos >= start and pos < end").select(doc, "idx").distinct().withColumn("hit", F.lit(True))
    close = sections.join(hits, doc).where(F.least(F.abs(F.col("pos") - F.col("start")), F.abs(F.col("pos") - F.col("end"))) < near).select(doc, "idx").distinct().withColumn("close", F.lit(True))
    w = W.partitionBy(doc).orderBy("idx")
    joined = sections.join(inside, [doc, "idx"], "left").join(close, [doc, "idx"], "left")
    beside = F.coalesce(F.lag("hit").over(w), F.lag("hit", -1).over(w), F.col("close"))
    return joined.withColumn("tier", F.when(F.col("hit"), "A").when(beside, "B").otherwise("C")).drop("hit", "close")


def in_order_batches(rows: DataFrame, group: str, size: str, order: str, budget: int) -> DataFrame:
    """``rows`` with batch: a new one whenever the next row would not fit."""

    def pack(state: dict, n: float) -> int:
        if state["used"] and state["used"] + n > budget:
            state["no"], state["used"] = state["no"] + 1, 0
        state["used"] += n
        return state["no"]

    return _running(rows, group, [order], size, "batch", "int", lambda: {"used": 0, "no": 0}, pack)


def extract(chunks: DataFrame, model, doc: str, text: str, done: DataFrame | None = None) -> DataFrame:
    """Items of each chunk by a pluggable model (a function from texts to JSON strings), without chunks that are done."""
    todo = chunks if done is None else chunks.join(done.select(doc, "chunk_index"), [doc, "chunk_index"], "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"d": pdf["d"], "chunk_index": pdf["chunk_index"], "answer": model(pdf["t"].tolist())})

    made = todo.select(F.col(doc).alias("d"), "chunk_index", F.col(text).alias("t")).mapInPandas(run, f"d {chunks.schema[doc].dataType.simpleString()}, chunk_index int, answer string")
    return made.withColumnRenamed("d", doc).withColumn("parsed", tx.loose_json(F.col("answer")))


ITEMS = "struct<entities:array<struct<name:string,type:string,local_offset:int>>,concepts:array<struct<term:string,definition_excerpt:string,local_offset:int>>,claims:array<struct<text:string,local_offset:int>>>"


def collect_items(extracts: DataFrame, doc: str) -> DataFrame:
    """(doc, chunk_index, kind, term, definition, offset) of ``extracts`` (doc, chunk_index, start, answer), one row an item.

    Entities become concepts whose definition is their type.  Offsets are those of the document: the chunk's start and the item's
    place in it, not below nought.  An answer that is no JSON object has no items.
    """
    a = F.from_json("answer", ITEMS)

    def of(xs, kind, term, text):
        return F.coalesce(F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), F.coalesce(term(x), F.lit("")).alias("term"), text(x).alias("definition"), F.greatest(F.lit(0), F.coalesce(x["local_offset"], F.lit(0))).alias("at"))), F.array())

    found = F.concat(
        of(a["entities"], "concept", lambda x: x["name"], lambda x: F.coalesce(x["type"], F.lit("other"))),
        of(a["concepts"], "concept", lambda x: x["term"], lambda x: x["definition_excerpt"]),
        of(a["claims"], "claim", lambda x: x["text"], lambda x: F.lit(None).cast("string")),
    )
    return extracts.select(doc, "chunk_index", "start", F.explode(found).alias("i")).select(doc, "chunk_index", "i.kind", "i.term", "i.definition", (F.col("start") + F.col("i.at")).alias("offset"))


def fold_classes(concepts: DataFrame, classes: DataFrame, key: str = "id") -> DataFrame:
    """(cluster, kept, term, definition, mentions, n): one concept for each class.

    ``concepts`` (key, term, definition, mentions), ``classes`` (key, cluster).  The one with most mentions, the first of equals,
    gives its name; the longest definition stays, that of the more mentioned of equals; mentions are summed.
    """
    c = F.col
    size = F.length(F.coalesce("definition", F.lit("")))
    first = F.struct("mentions", -c(key))
    return concepts.join(classes.select(key, "cluster"), key).groupBy("cluster").agg(
        F.max_by(key, first).alias("kept"), F.max_by("term", first).alias("term"), F.max_by("definition", F.struct(size, c("mentions"), -c(key))).alias("definition"),
        F.sum("mentions").alias("mentions"), F.count("*").alias("n"),
    )


#: By strategy, the least and most pages to plan, and concepts to a page.
PAGES = {"single_pass": (3, 30, 2), "standard": (8, 80, 3), "hierarchical": (15, 200, 3)}
#: What evidence inside a section counts, how far evidence beside it counts, and what each place further down costs.
INSIDE, NEAR, LATER = 3.0, 5000, 0.02


def target_pages(concepts: Column, strategy: Column) -> Column:
    """How many pages to plan for so many concepts."""
    of = lambda low, high, per: F.greatest(F.lit(low), F.least(F.lit(high), F.floor(concepts / per).cast("int")))
    return F.when(strategy == "single_pass", of(*PAGES["single_pass"])).when(strategy == "standard", of(*PAGES["standard"])).otherwise(of(*PAGES["hierarchical"]))


def section_scores(sections: DataFrame, hits: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``sections`` (doc, idx, start, end) with n_hits and score, for evidence (doc, pos).

    Evidence inside counts 3 and 1, evidence beside it the less the further away, earlier sections a little more; in documents
    without evidence each scores 1.
    """
    c = F.col
    inside = (c("pos") >= c("start")) & (c("pos") < c("end"))
    away = F.least(F.abs(c("pos") - c("start")), F.abs(c("pos") - c("end")))
    near = F.when(inside, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - away / NEAR))
    met = sections.join(hits.groupBy(doc, "pos").agg(F.count("*").alias("w")), doc, "left").groupBy(doc, "idx", "start", "end").agg(
        F.coalesce(F.sum(F.when(inside, c("w"))), F.lit(0)).alias("n_hits"), F.sum(near * c("w")).alias("near")
    )
    bonus = F.greatest(F.lit(0.0), 1.0 - c("idx") * LATER)
    return met.select(doc, "idx", "start", "end", "n_hits", F.when(c("near").isNull(), 1.0).otherwise(INSIDE * c("n_hits") + c("near") + bonus).alias("score"))


def images_near(images: DataFrame, hits: DataFrame, doc: str = "doc_id", reach: int = 1500) -> DataFrame:
    """(doc, image, away): images (doc, image, pos) within reach of evidence (doc, pos), each once with its least distance."""
    w = W.partitionBy(doc).orderBy("pos")
    spots = images.select(doc, "image", "pos").unionByName(hits.select(doc, F.lit(None).cast(images.schema["image"].dataType).alias("image"), "pos"))
    known = F.when(F.col("image").isNull(), F.col("pos"))
    sides = spots.withColumn("before", F.last(known, True).over(w.rangeBetween(W.unboundedPreceding, W.currentRow))).withColumn("after", F.first(known, True).over(w.rangeBetween(W.currentRow, W.unboundedFollowing)))
    away = F.least(F.col("pos") - F.col("before"), F.col("after") - F.col("pos"))
    return sides.where("image is not null").select(doc, "image", away.alias("away")).groupBy(doc, "image").agg(F.min("away").alias("away")).where(F.col("away") <= reach)
