"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v) rows with u > v.

    Large star: every neighbour above a node is joined to the least node that
    is the node itself or a neighbour. Small star: the node and its lesser
    neighbours are joined to the least of them. The least neighbours are a
    stored table, so both join inputs are plain exchanges and a hub with a
    third of all edges is split by the skew join.
    """
    if large:
        ends = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        least = materialize(least, "cc-least")
        moved = ends.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        moved = (edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(least.select("u", F.col("m").alias("v"))))
    return moved.distinct()


def _stored(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    seen = Observation(f"{name}-{id(edges)}")
    watched = edges.observe(seen, F.count(F.lit(1)).alias("n"),
                            F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x"))
    frame = materialize(watched, name)
    got = seen.get
    return frame, (int(got.get("n") or 0), int(got.get("x") or 0))


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) bigint links -> (node, root): the least node reachable.

    Only nodes with a link to another node appear. Null ends, self links and
    repeated links are ignored; an empty table gives an empty table. Each round
    is stored in the shared checkpoint folder, the driver sees two numbers.
    """
    pairs = (edges.where("u <> v")
             .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now, mark = _stored(pairs, "cc-edges")
    while mark[0]:
        now, after = _stored(_star(_star(now, large=True), large=False), "cc-edges")
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
