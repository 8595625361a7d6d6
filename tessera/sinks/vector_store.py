"""Document vectors stored for reads by id and in pages.

Rows are cut into ranges of ids, one folder of files each, sorted inside. A manifest
holds the least and largest id and the number of rows of every range, so a reader
opens only the folders it needs; inside them the id predicate reaches the Parquet row
groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 16
ROW_GROUP_BYTES = 4 << 20  # small groups, so that a point read skips most of a file


def write_vectors(vectors: DataFrame, path: str, id_col: str = "doc_id", parts: int = PARTS) -> None:
    """Stores all rows with an id; ``parts`` grows with the table (some 10^5 vectors a
    range keep a page read small). Equal ids share a range."""
    ranged = vectors.where(F.col(id_col).isNotNull()).repartitionByRange(parts, id_col).withColumn("part", F.spark_partition_id())
    (ranged.sortWithinPartitions("part", id_col).write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES)
           .partitionBy("part").parquet(f"{path}/vectors"))
    stored = vectors.sparkSession.read.parquet(f"{path}/vectors")
    (stored.groupBy("part").agg(F.min(id_col).alias("least"), F.max(id_col).alias("most"), F.count(F.lit(1)).alias("n"))
           .coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest"))


def _parts(spark: SparkSession, path: str, parts: list[int]) -> DataFrame:
    stored = spark.read.parquet(f"{path}/vectors")
    return stored.where(F.col("part").isin(parts)).drop("part")  # a partition filter: no other folder is opened


def read_vector(spark: SparkSession, path: str, doc_id, id_col: str = "doc_id") -> DataFrame:
    """The rows with this id: the one range that can hold it is read."""
    manifest = spark.read.parquet(f"{path}/manifest").where((F.col("least") <= F.lit(doc_id)) & (F.col("most") >= F.lit(doc_id)))
    return _parts(spark, path, [r.part for r in manifest.collect()]).where(F.col(id_col) == F.lit(doc_id))


def read_page(spark: SparkSession, path: str, after, n: int, id_col: str = "doc_id") -> DataFrame:
    """The next ``n`` rows after id ``after`` (from the first if null) in id order: the
    range ``after`` falls in and as many after it as hold ``n`` rows."""
    ranges = spark.read.parquet(f"{path}/manifest").orderBy("least")
    if after is not None:
        ranges = ranges.where(F.col("most") > F.lit(after))
    wanted, held = [], 0
    for r in ranges.collect():  # one row per range
        if held >= n:
            break
        wanted.append(r.part)
        if after is None or r.least > after:
            held += r.n
    rows = _parts(spark, path, wanted)
    return (rows if after is None else rows.where(F.col(id_col) > F.lit(after))).orderBy(id_col).limit(n)
