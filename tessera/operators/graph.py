"""Category graph: edge filters, title resolution, bounded level-by-level descent.

``links`` has the category-link shape ``(cl_from LONG, cl_to STRING, cl_type STRING)``
and ``page`` the page shape ``(page_id LONG, page_title STRING)``. A ``subcat``
row says: the page ``cl_from`` is a category whose title is a child of ``cl_to``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

PAGE = "page"
SUBCAT = "subcat"


def edge_kind_filter(links: DataFrame, kind: str) -> DataFrame:
    return links.filter(F.col("cl_type") == F.lit(kind))


def resolve_titles(edges: DataFrame, page: DataFrame, id_col: str = "cl_from",
                   title_col: str = "child_title") -> DataFrame:
    """Attach the title of the page named by ``id_col`` (one join, no lookups per key).

    Edges whose page has no title row are dropped (inner join).
    """
    titles = page.select(F.col("page_id").alias("_tid"), F.col("page_title").alias(title_col))
    return (edges.join(titles, edges[id_col] == titles["_tid"], "inner").drop("_tid"))


def subcategory_edges(links: DataFrame, page: DataFrame) -> DataFrame:
    """``(parent, child)`` category titles, from subcat links and page titles."""
    sub = edge_kind_filter(links, SUBCAT).select("cl_from", F.col("cl_to").alias("parent"))
    return resolve_titles(sub, page, "cl_from", "child").select("parent", "child")


def category_members(frontier: DataFrame, links: DataFrame, page: DataFrame,
                     category_col: str = "category") -> DataFrame:
    """Member pages and child categories of each category in ``frontier``.

    Output: ``(category, member_id, kind, child_title)``; ``child_title`` is
    null for pages.
    """
    cats = frontier.select(F.col(category_col).alias("category")).distinct()
    pages = (edge_kind_filter(links, PAGE)
             .join(cats, F.col("cl_to") == F.col("category"), "inner")
             .select("category", F.col("cl_from").alias("member_id"),
                     F.lit(PAGE).alias("kind"), F.lit(None).cast("string").alias("child_title")))
    subs = (edge_kind_filter(links, SUBCAT)
            .join(cats, F.col("cl_to") == F.col("category"), "inner")
            .select("category", "cl_from"))
    subs = resolve_titles(subs, page, "cl_from", "child_title").select(
        "category", F.col("cl_from").alias("member_id"), F.lit(SUBCAT).alias("kind"), "child_title")
    return pages.unionByName(subs)


def _seed_frame(spark: SparkSession, seeds) -> DataFrame:
    if isinstance(seeds, DataFrame):
        return seeds.select(F.col(seeds.columns[0]).cast("string").alias("category"))
    if isinstance(seeds, str):
        seeds = [seeds]
    # built from a one-row range (not an RDD of Python rows) so the planner
    # knows the seed set is tiny and can broadcast what is derived from it
    lits = [F.lit(str(s)) for s in seeds]
    arr = F.array(*lits) if lits else F.array().cast("array<string>")
    return spark.range(1).select(F.explode(arr).alias("category"))


def descent_categories(links: DataFrame, page: DataFrame, seeds, max_depth: int = 3) -> DataFrame:
    """Categories reached from ``seeds`` within ``max_depth`` subcat steps: ``(category, depth)``.

    Level by level: a category is kept at the least depth it is first met
    (anti-join against what was already visited), which reaches exactly the
    categories a walk without a visited set reaches, and ends on cycles.
    Each level is written to the shared checkpoint folder so lineage stays
    short, a lost executor recomputes at most one level, and the planner
    sees each frontier's real size (small frontiers are broadcast).
    """
    spark = links.sparkSession
    edges = materialize(subcategory_edges(links, page), "subcat-edges")
    frontier = _seed_frame(spark, seeds).distinct()
    levels = [frontier.withColumn("depth", F.lit(0))]
    visited = frontier
    for depth in range(1, max_depth + 1):
        nxt = (frontier.join(edges, frontier["category"] == edges["parent"], "inner")
                       .select(F.col("child").alias("category")).distinct()
                       .join(visited, "category", "left_anti"))
        nxt, n = materialize(nxt, "frontier", count=True)
        if n == 0:
            break
        levels.append(nxt.withColumn("depth", F.lit(depth)))
        visited = visited.unionByName(nxt)
        frontier = nxt
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out


def category_descent(links: DataFrame, page: DataFrame, seeds, max_depth: int = 3) -> DataFrame:
    """Distinct member-page ids of every category within ``max_depth`` of the seeds.

    All seeds are unioned. The member join runs once, over all reached
    categories (semi-join), instead of once per level.
    """
    cats = descent_categories(links, page, seeds, max_depth).select("category")
    return (edge_kind_filter(links, PAGE)
            .join(cats, F.col("cl_to") == F.col("category"), "left_semi")
            .select(F.col("cl_from").alias("page_id")).distinct())


def union_distinct(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()
