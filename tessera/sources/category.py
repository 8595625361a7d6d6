"""Category tables ``page`` and ``categorylinks`` from Parquet or JDBC.

Connection options always come from the caller; nothing is hard-coded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _normalise(page: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    page = page.select(F.col("page_id").cast("long").alias("page_id"),
                       F.col("page_title").cast("string").alias("page_title"))
    links = links.select(F.col("cl_from").cast("long").alias("cl_from"),
                         F.col("cl_to").cast("string").alias("cl_to"),
                         F.col("cl_type").cast("string").alias("cl_type"))
    return page, links


def scan_category_tables(spark: SparkSession, page_path: str, links_path: str,
                         fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """``(page, categorylinks)`` with byte titles decoded as UTF-8 strings."""
    reader = spark.read.format(fmt)
    return _normalise(reader.load(page_path), reader.load(links_path))


def scan_category_tables_jdbc(spark: SparkSession, url: str, properties: dict,
                              num_partitions: int = 64, page_bounds: tuple[int, int] | None = None,
                              link_bounds: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Partitioned JDBC reads (``page_id`` / ``cl_from`` ranges split over tasks)."""
    def read(table, column, bounds):
        if bounds is None:
            return spark.read.jdbc(url, table, properties=properties)
        lo, hi = bounds
        return spark.read.jdbc(url, table, column=column, lowerBound=lo, upperBound=hi,
                               numPartitions=num_partitions, properties=properties)
    return _normalise(read("page", "page_id", page_bounds),
                      read("categorylinks", "cl_from", link_bounds))
