"""Sinks. Everything is written by the executors, never through the driver."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T
from .doc_files import DocFilesSource


def write_id_list(ids: DataFrame, path: str, id_col: str = "page_id") -> int:
    """One id per line; returns the count gathered by an observation (no second pass)."""
    obs = Observation("ids")
    (ids.select(F.col(id_col).cast("string").alias("value"))
        .observe(obs, F.count(F.lit(1)).alias("n"))
        .write.mode("overwrite").text(path))
    return int(obs.get["n"])


def write_documents(docs: DataFrame, path: str, fmt: str = "parquet",
                    id_col: str = "doc_id", title_col: str | None = "title",
                    text_col: str = "text") -> None:
    """Parquet keyed (sorted within files) by ``doc_id`` by default.

    ``fmt="files"`` writes one file per document, ``id_<id>.txt``, holding title +
    newline + text; rows without id, title or text are left out, a repeated id fails
    (found by a pass over the ids, so ``docs`` has to give the same rows twice), and
    nothing is left of a failed job. The files are moved to their place by the
    driver at the end (one rename each), so this is for exports.
    ``fmt="text"`` writes one folder per document (``doc_id=<id>``), for small exports
    only.
    """
    if fmt == "parquet":
        docs.sortWithinPartitions(id_col).write.mode("overwrite").parquet(path)
    elif fmt == "files":
        body = T.compose_document(title_col, text_col) if title_col else F.col(text_col)
        whole = docs.dropna(subset=[id_col, text_col, *([title_col] if title_col else [])]).select(F.col(id_col).cast("bigint").alias("doc_id"), body.alias("body"))
        twice = whole.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id").first()  # ids are shuffled, texts are not
        if twice:
            raise ValueError(f"two documents with id {twice['doc_id']}: they would share a file")
        docs.sparkSession.dataSource.register(DocFilesSource)
        whole.write.mode("overwrite").format("doc_files").save(path)
    elif fmt == "text":
        body = T.compose_document(title_col, text_col) if title_col else F.col(text_col)
        (docs.select(id_col, body.alias("value"))
             .repartition(id_col).write.mode("overwrite").partitionBy(id_col).text(path))
    else:
        raise ValueError(fmt)


def write_documents_bucketed(docs: DataFrame, table: str, buckets: int, id_col: str = "doc_id",
                             path: str | None = None) -> None:
    """Store documents as a table bucketed and sorted by ``doc_id``.

    Reading it back, Spark knows the rows are hash-partitioned by
    ``doc_id``: term frequencies, per-document aggregates and joins with
    other tables bucketed the same way run without a shuffle.
    """
    writer = docs.write.mode("overwrite").format("parquet").bucketBy(buckets, id_col).sortBy(id_col)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def write_artifacts(frames: dict[str, DataFrame], root: str) -> None:
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(os.path.join(root, name))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Append ``(run, iteration, metric, value)`` rows; earlier rows are kept."""
    metrics.select(F.col("run").cast("string"), F.col("iteration").cast("long"),
                   F.col("metric").cast("string"), F.col("value").cast("double")) \
        .write.mode("append").parquet(path)
