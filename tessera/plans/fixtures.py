"""Derived inputs, each defined once here (Spark) and once in ``oracle.py`` (SQL).

G1  category graph from region / nation / customer / supplier / orders
L1  label long form from documents + labels; L1b only the quality/toxic flags
V1  vocabulary of the tokens of ``documents``
W1  word vectors: the V1 word of rank r gets ``embeddings`` row ``vec_id = r`` modulo their number
P1  class weights: per ``embeddings.label``, the per-dimension mean; bias 0
"""

from __future__ import annotations

import os

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text as TX
from ..session import materialize, spread
from ..operators import vectors as V

ROOT_CATEGORY = "ROOT"
PARTIAL_SEEDS = ("ASIA", "NATION_3")  # a region and a nation: most of the graph is out of their reach
# Id offsets keeping page ids of the five entity kinds disjoint.
REGION_BASE, NATION_BASE, CUSTOMER_BASE, SUPPLIER_BASE, ORDER_BASE = (
    1_000_000_000, 2_000_000_000, 3_000_000_000, 4_000_000_000, 5_000_000_000)
SPLICE_MARKS = " [1] [x] [12]b [[3]] [] "


# Tables whose rows carry long text: CPU-heavy per row, so spread them over
# all cores when the file gives too few partitions, hash-partitioned on their
# id so per-document aggregates and joins downstream need no further shuffle
# (what bucketing the table by that id gives on a cluster).
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "benchmark": "item_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df, key=TEXT_TABLES[name]) if name in TEXT_TABLES else df


def _key(c: str, base: int):
    return (F.col(c).cast("long") + F.lit(base)).alias("k")


def category_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """G1: ``(page, categorylinks)``."""
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    supplier = table(spark, sf_dir, "supplier")
    orders = table(spark, sf_dir, "orders")
    page = (region.select(_key("r_regionkey", REGION_BASE), F.col("r_name").alias("t"))
            .unionByName(nation.select(_key("n_nationkey", NATION_BASE), F.col("n_name").alias("t")))
            .unionByName(customer.select(_key("c_custkey", CUSTOMER_BASE), F.col("c_name").alias("t")))
            .select(F.col("k").alias("page_id"), F.col("t").alias("page_title")))
    reg = region.select("r_regionkey", "r_name")
    nat = nation.select("n_nationkey", "n_name", "n_regionkey")
    cus = customer.select("c_custkey", "c_name", "c_nationkey")

    def edges(df, key, base, parent, kind):
        return df.select((F.col(key).cast("long") + F.lit(base)).alias("cl_from"),
                         F.col(parent).alias("cl_to"), F.lit(kind).alias("cl_type"))

    links = (edges(reg.withColumn("root", F.lit(ROOT_CATEGORY)), "r_regionkey", REGION_BASE, "root", "subcat")
             .unionByName(edges(nat.join(reg, F.col("n_regionkey") == F.col("r_regionkey")),
                                "n_nationkey", NATION_BASE, "r_name", "subcat"))
             .unionByName(edges(cus.join(nat, F.col("c_nationkey") == F.col("n_nationkey")),
                                "c_custkey", CUSTOMER_BASE, "n_name", "subcat"))
             .unionByName(edges(supplier.select("s_suppkey", "s_nationkey")
                                .join(nat, F.col("s_nationkey") == F.col("n_nationkey")),
                                "s_suppkey", SUPPLIER_BASE, "n_name", "page"))
             .unionByName(edges(orders.select("o_orderkey", "o_custkey")
                                .join(cus, F.col("o_custkey") == F.col("c_custkey")),
                                "o_orderkey", ORDER_BASE, "c_name", "page")))
    return page, links


def label_links(spark: SparkSession, sf_dir: str, with_doc_fields: bool = True) -> DataFrame:
    """L1 (or L1b without the lang/source labels): ``(doc_id, label)``."""
    labels = table(spark, sf_dir, "labels")
    flags = (labels.filter(F.col("quality") == 1).select("doc_id", F.lit("quality").alias("label"))
             .unionByName(labels.filter(F.col("toxic") == 1).select("doc_id", F.lit("toxic").alias("label"))))
    if not with_doc_fields:
        return flags
    docs = table(spark, sf_dir, "documents")
    # one scan of documents yields both of its labels
    both = F.array(F.concat(F.lit("lang="), "lang"), F.concat(F.lit("source="), "source"))
    return docs.select("doc_id", F.explode(both).alias("label")).unionByName(flags)


def spliced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with citation marks, blank lines and a category line appended."""
    docs = table(spark, sf_dir, "documents")
    text = F.concat(F.col("text"), F.lit(SPLICE_MARKS), F.lit("\n"), F.lit("  "), F.lit("\n"),
                    F.lit("Category:"), F.col("source"), F.lit(" ["), F.col("doc_id").cast("string"),
                    F.lit("]"))
    return docs.select("doc_id", text.alias("text"))


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form tokens of ``documents`` (no cleaning, no stop list)."""
    return TX.tokens_long(table(spark, sf_dir, "documents").select("doc_id", "text"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1."""
    return V.build_vocabulary(document_tokens(spark, sf_dir))


def word_vectors(spark: SparkSession, sf_dir: str, vocab: DataFrame | None = None) -> DataFrame:
    """W1: ``(word, vector ARRAY<DOUBLE>)``.

    Stored like the saved word-vector artifact it stands for, so later joins
    plan with its real size (a derived join result has no usable estimate).
    """
    vocab = vocabulary(spark, sf_dir) if vocab is None else vocab
    emb = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    # every vocabulary word has a vector: word idx takes embedding idx mod n
    n = emb.select(F.count(F.lit(1))).scalar()
    w1 = (vocab.withColumn("_vec", F.col("idx") % n)
          .join(emb, F.col("_vec") == F.col("vec_id"), "inner").select("word", "vector"))
    return materialize(w1, "word-vectors")


def embedding_dim(spark: SparkSession, sf_dir: str) -> int:
    """Vector width: one aggregate over the embedding table."""
    row = table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding"))).first()
    return int(row[0] or 0)


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1: ``(unit, w ARRAY<DOUBLE>, b)`` = per-label mean embedding, bias 0.

    Stored once, like a saved weight table, so the size check and the
    scoring read it instead of re-aggregating the embeddings.
    """
    emb = table(spark, sf_dir, "embeddings").select(
        "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    p1 = (emb.groupBy("label").agg(Summarizer.mean(F.col("v")).alias("m"))
             .select(F.col("label").cast("int").alias("unit"), vector_to_array("m").alias("w"),
                     F.lit(0.0).alias("b")))
    return materialize(p1, "class-weights")


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")


def pages_as_dump_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dump-shaped rows from ``pages``: title = url, id = page_id, and two
    revisions whose ids equal other pages' ids (page_id + 1, page_id + 2);
    the older revision holds the url, the newer one the whole html."""
    pages = table(spark, sf_dir, "pages")

    def rev(offset, text):
        return F.struct((F.col("page_id") + F.lit(offset)).alias("id"),
                        F.struct(text.alias("_VALUE")).alias("text"))

    return pages.select(F.col("url").alias("title"), F.lit(0).alias("ns"),
                        F.col("page_id").alias("id"),
                        F.array(rev(1, F.col("url")), rev(2, F.col("html"))).alias("revision"))


def write_dump(rows: DataFrame, path: str) -> str:
    (rows.write.mode("overwrite").format("xml")
         .option("rootTag", "mediawiki").option("rowTag", "page").save(path))
    return path
