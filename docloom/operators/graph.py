"""Links between pages: edges, neighbourhoods, typed unions and lint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import staged


def links(pages: DataFrame, page: str, targets: Column, own: Column) -> DataFrame:
    """(from_page, to_slug): each target once, without links of a page to itself."""
    found = pages.select(F.col(page).alias("from_page"), F.explode(targets).alias("to_slug"), own.alias("own"))
    return found.where("to_slug != own").select("from_page", "to_slug").dropDuplicates()


def backlinks(edges: DataFrame) -> DataFrame:
    return edges.groupBy("to_slug").agg(F.countDistinct("from_page").alias("n_backlinks"))


def outlinks(edges: DataFrame) -> DataFrame:
    return edges.groupBy("from_page").agg(F.count("*").alias("n_outlinks"))


def dead_links(edges: DataFrame, slugs: DataFrame) -> DataFrame:
    """Edges whose target is no page: ``slugs`` has a column slug."""
    return edges.join(slugs.select(F.col("slug").alias("to_slug")), "to_slug", "left_anti")


def orphans(slugs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages that nothing links to."""
    return slugs.join(edges.select(F.col("to_slug").alias("slug")), "slug", "left_anti")


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int, a: str = "a", b: str = "b") -> DataFrame:
    """(node, dist): what is reachable from ``seeds`` (node) in at most ``depth`` (1 to 3) steps along edges of either way."""
    depth = min(3, max(1, depth))
    # Each step reads the edges, so they are written once.  Repeated ones stay: a step's nodes are made distinct anyhow, and there are fewer of them.
    edges = staged(edges.select(F.col(a).alias("u"), F.col(b).alias("node")).where("u is not null and node is not null"), "edges")
    both = edges.union(edges.select("node", "u"))
    found = staged(seeds.select("node", F.lit(0).alias("dist")).distinct(), "front")
    front = found
    for step in range(1, depth + 1):
        front = front.select(F.col("node").alias("u")).join(both, "u").select("node").distinct().join(found, "node", "left_anti").withColumn("dist", F.lit(step))
        front = staged(front, "front")  # its size is known then, so a small one is sent to the edges
        found = found.unionByName(front)
    return found


def edges_within(edges: DataFrame, nodes: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    one = nodes.select("node")
    return edges.join(one.withColumnRenamed("node", a), a, "left_semi").join(one.withColumnRenamed("node", b), b, "left_semi")


def typed_union(**kinds: DataFrame) -> DataFrame:
    """One table (source, target, weight, kind) of edges of several kinds."""
    out = None
    for kind, df in kinds.items():
        df = df.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), F.col("weight").cast("double").alias("weight"), F.lit(kind).alias("kind"))
        out = df if out is None else out.unionByName(df)
    return out


def lint(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, page, detail) of dead links, orphans and contradictions, for pages (page, slug, contradicts boolean)."""
    dead = dead_links(edges, pages).select(F.lit("dead_link").alias("kind"), F.col("from_page").alias("page"), F.col("to_slug").alias("detail"))
    alone = orphans(pages.select("slug", "page"), edges).select(F.lit("orphan").alias("kind"), "page", F.col("slug").alias("detail"))
    against = pages.where("contradicts").select(F.lit("contradiction").alias("kind"), "page", F.col("slug").alias("detail"))
    return dead.unionByName(alone).unionByName(against)


def resolve_concepts(relations: DataFrame, pages: DataFrame) -> DataFrame:
    """Concept relations (source, target, ...) with the pages of that title or slug, case and outer blanks aside; a slug goes before a title, then the least page."""
    names = pages.select(F.lower(F.trim("slug")).alias("name"), F.lit(0).alias("way"), "page").unionByName(pages.select(F.lower(F.trim("title")).alias("name"), F.lit(1).alias("way"), "page"))
    best = names.where("name != ''").groupBy("name").agg(F.min(F.struct("way", "page")).alias("m")).select("name", F.col("m.page").alias("page"))
    out = relations
    for end in ("source", "target"):
        hit = best.select(F.col("name").alias(f"__{end}"), F.col("page").alias(f"{end}_page"))
        out = out.join(hit, F.lower(F.trim(end)) == F.col(f"__{end}"), "left").drop(f"__{end}")
    return out


def index_lines(pages: DataFrame) -> DataFrame:
    """One line of text for each type of page: its titles, in order."""
    line = F.concat(F.lit("- [["), F.col("slug"), F.lit("|"), F.col("title"), F.lit("]]"))
    lines = F.array_sort(F.collect_list(F.struct(F.lower("title").alias("t"), F.col("slug").alias("s"), line.alias("line"))))
    return pages.groupBy("page_type").agg(lines.alias("l")).select("page_type", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("lines"))
