"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that no column an operator adds
    can clash with a column of the caller."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def fold(doc_id: Column, modulus: int, held: int) -> Column:
    """True for the held-out rows: crc32 of the id as text, modulo ``modulus``.
    A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(modulus) == F.lit(held), F.lit(False))


def one_label_per_id(labels: DataFrame, label: str, merge) -> DataFrame:
    """(doc_id, label): rows without an id or a label go; repeated ids are
    merged with ``merge`` (``F.min`` or ``F.max``)."""
    return (labels.select("doc_id", F.col(label).cast("int").alias("label"))
            .where("doc_id is not null and label is not null")
            .groupBy("doc_id").agg(merge("label").alias("label")))


def spread_by_hash(n: int):
    """Order rows by a hash of their id: a stable sample is its first rows."""
    return F.xxhash64(F.col("doc_id"), F.lit(n))


def task_count(spark: SparkSession, work: int, most: int, least: int) -> int:
    """Tasks for ``work`` units (rows or bytes): as many as the shuffle has
    partitions, but with no fewer than ``least`` units in a task, and more of them
    where a task would get over ``most``. For stages whose input is small beside
    what they do, so that the planner would merge it into a few tasks."""
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-work // most), min(wanted, -(-work // least)))


def row_key() -> list[Column]:
    """(row_id, row_hash) of a row with doc_id and text; never null. Rows with an
    equal key are copies of one row, so texts need not be stored to find them
    again: a second reading joins what the first one found by this key."""
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("row_id"),
            F.xxhash64(F.col("text").cast("string")).alias("row_hash")]
