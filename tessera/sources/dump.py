"""Encyclopedia dump XML: one row per ``<page>``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


REVISION = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("text", T.StructType([T.StructField("_VALUE", T.StringType())])),
])

PAGE_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("ns", T.IntegerType()),
    T.StructField("id", T.LongType()),
    T.StructField("revision", T.ArrayType(REVISION)),
])


MALFORMED = "_corrupt_record"


def read_dump_pages(spark: SparkSession, path: str, schema: T.StructType = PAGE_SCHEMA,
                    mode: str = "PERMISSIVE") -> DataFrame:
    """Raw page rows with a fixed schema (no inference pass over the dump).
    ``mode="FAILFAST"`` fails on a page that does not fit it.

    The XML source splits the file on ``<page>`` boundaries, so a large dump
    is read by many tasks. Surrounding white space of text is kept.
    """
    return (spark.read.format("xml").option("rowTag", "page")
            .option("ignoreSurroundingSpaces", "false")
            .option("ignoreNamespace", "true")
            .option("mode", mode).option("columnNameOfCorruptRecord", MALFORMED)
            .schema(schema).load(path))


def page_text(revision_col: str = "revision", which: str = "last") -> F.Column:
    """Text of the last (streaming reader) or first (tree reader) revision
    that has one; an empty ``<text/>`` is null."""
    with_text = F.filter(F.col(revision_col), lambda r: r["text"]["_VALUE"].isNotNull())
    pos = {"last": -1, "first": 1}[which]
    return F.try_element_at(with_text, F.lit(pos))["text"]["_VALUE"]


def scan_dump(spark: SparkSession, path: str, drop_incomplete: bool = True,
              revision: str = "last", mode: str = "PERMISSIVE") -> DataFrame:
    """``(id, title, text)`` per page: the page's own id (never a revision id).
    Pages that do not fit the schema lack what is wrong in them;
    ``malformed_pages`` shows them, ``mode="FAILFAST"`` fails on them."""
    pages = read_dump_pages(spark, path, mode=mode).select(
        F.col("id").alias("id"), F.col("title"), page_text("revision", revision).alias("text"))
    if drop_incomplete:
        pages = pages.dropna(subset=["id", "title", "text"])
    return pages


def malformed_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(id, ns, title, revisions, source)`` of the pages that do not fit the
    schema. All fields are returned, as only fields that are read are checked."""
    schema = T.StructType([*PAGE_SCHEMA.fields, T.StructField(MALFORMED, T.StringType())])
    pages = read_dump_pages(spark, path, schema).where(F.col(MALFORMED).isNotNull())
    return pages.select("id", "ns", "title", F.size("revision").alias("revisions"), F.col(MALFORMED).alias("source"))
