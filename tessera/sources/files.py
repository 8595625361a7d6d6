"""Plain-text inputs: id lists and folders with one document per file."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

CODEC_SUFFIXES = ("bz2", "deflate", "gz", "lz4", "snappy", "zst")  # the codecs Hadoop picks by file name
FILES_INDEXED = 20_000  # files of a folder up to which Spark's index, kept whole by the driver, lists it
FILES_PER_TASK, NAMES_PER_BATCH, BATCH_BYTES = 4_000, 10_000, 4 << 20  # of larger folders

def scan_id_list(spark: SparkSession, path: str, distinct: bool = True) -> DataFrame:
    """One integer per line -> ``(id LONG)``; lines that are not numbers are null and dropped."""
    ids = (spark.read.text(path).select(F.trim(F.col("value")).try_cast("long").alias("id"))
           .filter(F.col("id").isNotNull()))
    return ids.distinct() if distinct else ids


def _drop_final_newline(value: F.Column) -> F.Column:
    """Remove exactly one trailing newline (the line writer adds one per row)."""
    return F.when(value.endswith("\n"), F.expr("substring(value, 1, length(value) - 1)")).otherwise(value)


def _doc_id_column(id_from: str) -> F.Column:
    if id_from == "file_name":          # id_<id>.txt
        return T.doc_id_from_file_name(F.col("_file.file_name"))
    if id_from == "partition":          # .../doc_id=<id>/part-...
        return F.regexp_extract(F.col("_file.file_path"), r"doc_id=(\d+)", 1).try_cast("long")
    raise ValueError(f"unknown id_from {id_from!r}")


def _visible(folder: bytes) -> Iterator[os.DirEntry]:
    """The entries of a folder that Spark's sources see, one after the other."""
    with os.scandir(folder) as entries:
        for e in entries:
            if not (e.name.startswith(b".") or e.name.startswith(b"_") and b"=" not in e.name or e.name.endswith(b"._COPYING_")):
                yield e


def _as_uri(name: bytes) -> bytes:
    """A file name as Spark's file metadata gives it: escaped like the path of a URI, letters of any script kept."""
    return re.sub(rb"[^A-Za-z0-9_.!~*'():@&=+$,;/\x80-\xff-]", lambda m: b"%%%02X" % ord(m[0]), name)


def _is_coded(name: bytes) -> bool:
    return name.lower().endswith(tuple(f".{s}".encode() for s in CODEC_SUFFIXES))


def _large_folder(spark: SparkSession, path: str) -> tuple[bytes, int, list[str]] | None:
    """``(folder, files, coded files)`` of a mounted folder with too many files for an index.

    Names are counted, never held. None where Spark's index does it: few files, folders
    within the folder (they may be partitions), patterns, and stores that are not mounted.
    """
    if not isinstance(path, str) or re.search(r"[*?\[{\\]", path):
        return None
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop_path).toUri()
    if uri.getScheme() != "file" or not os.path.isdir(uri.getPath()):
        return None
    folder, n, coded = os.fsencode(uri.getPath()), 0, []
    for e in _visible(folder):
        if e.is_dir():
            return None
        n += 1
        if _is_coded(e.name):
            coded.append(os.fsdecode(e.name))
            if len(coded) > FILES_INDEXED:
                return None
    return (folder, n, coded) if n > FILES_INDEXED else None


def _dealt_files(spark: SparkSession, folder: bytes, n: int) -> DataFrame:
    """``(value, _file)`` of the plain files of a large folder: one task lists the names,
    which are dealt to tasks that open the files."""
    def listed(_) -> Iterator[pa.RecordBatch]:
        names = []
        for e in _visible(folder):
            if not _is_coded(e.name):
                names.append(e.name)
            if len(names) == NAMES_PER_BATCH:
                yield pa.record_batch({"name": pa.array(names, pa.binary())})
                names = []
        yield pa.record_batch({"name": pa.array(names, pa.binary())})

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda read: pa.record_batch({c: pa.array(v, pa.binary()) for c, v in zip(("name", "content"), zip(*read, strict=True), strict=True)})
        for batch in batches:
            read, held = [], 0
            for name in batch.column("name").to_pylist():
                with open(os.path.join(folder, name), "rb") as f:
                    content = f.read()
                if content:  # Spark's sources give no row for an empty file
                    read.append((_as_uri(name), content))
                    held += len(content)
                if held >= BATCH_BYTES:
                    yield rows(read)
                    read, held = [], 0
            if read:
                yield rows(read)

    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(n / FILES_PER_TASK))
    names = spark.range(0, 1, 1, 1).mapInArrow(listed, "name binary").repartition(tasks, "name")
    name, root = F.col("name").cast("string"), f"file:{os.fsdecode(_as_uri(folder.rstrip(b'/')))}/"
    return names.mapInArrow(opened, "name binary, content binary").select(
        F.col("content").cast("string").alias("value"), F.struct(F.concat(F.lit(root), name).alias("file_path"), name.alias("file_name")).alias("_file"))


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``(value, _file)``: the bytes of every file as text, with its path and name.

    The binary source opens a file at a fraction of what the text source spends on
    setting up a record reader for it; only files that need a codec go through that.
    Both list the whole folder on the driver, and plan a task for a few files each, so
    a large folder is listed and dealt by the executors.
    """
    meta = F.struct("_metadata.file_path", "_metadata.file_name").alias("_file")
    large = _large_folder(spark, path)
    if large:
        folder, n, names = large
        plain = _dealt_files(spark, folder, n)
        if not names:
            return plain
        root = os.fsdecode(folder)
        coded = spark.read.text([re.sub(r"([*?\[\]{}\\])", r"\\\1", f"{root}/{name}") for name in names], wholetext=True)
    else:
        plain = (spark.read.format("binaryFile").load(path).select(F.col("content").cast("string").alias("value"), meta)
                 .where(~F.lower("_file.file_name").rlike(rf"\.({'|'.join(CODEC_SUFFIXES)})$")))
        either = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix) for suffix in CODEC_SUFFIXES]
        coded = spark.read.option("pathGlobFilter", f"*.{{{','.join(either)}}}").text(path, wholetext=True)
    return plain.unionByName(coded.select("value", meta))


def read_whole_files(spark: SparkSession, path: str, id_from: str = "file_name",
                     strip_final_newline: bool = False) -> DataFrame:
    """``(doc_id, value)``: one row per file.

    Many small files should be read once this way and kept as Parquet keyed
    by ``doc_id``; Spark packs several small files into one task.
    """
    value = F.col("value")
    if strip_final_newline:
        value = _drop_final_newline(value)
    return _whole_files(spark, path).select(_doc_id_column(id_from).alias("doc_id"), value.alias("value"))


def scan_documents(spark: SparkSession, path: str, id_from: str = "file_name",
                   strip_final_newline: bool = False) -> DataFrame:
    """``(doc_id, title, text)``: the first line of a file is its title."""
    files = read_whole_files(spark, path, id_from, strip_final_newline)
    parts = T.split_title("value")
    return files.select("doc_id", parts["title"].alias("title"), parts["text"].alias("text"))


def scan_doc_lines(spark: SparkSession, path: str, id_from: str = "file_name",
                   strip_final_newline: bool = True) -> DataFrame:
    """``(doc_id, file_name, line_no, line)``: every line of every file, in order."""
    value = F.col("value")
    if strip_final_newline:
        value = _drop_final_newline(value)
    return _whole_files(spark, path).select(
        _doc_id_column(id_from).alias("doc_id"), F.col("_file.file_name").alias("file_name"),
        F.posexplode(F.split(value, "\n")).alias("line_no", "line"))
