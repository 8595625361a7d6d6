"""Session helpers: building a session and locating shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "tessera", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, local_folder)
    return spark


def local_folder() -> str:
    """A new temporary folder, for sessions that run in one process."""
    return tempfile.mkdtemp(prefix="tessera-ckpt-")


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession, local_default: Callable[[], str] | None = None) -> str:
    """Return the shared checkpoint folder the cluster names.

    The setting is read from the session (``spark.checkpoint.dir`` or the
    context's checkpoint dir). Unset is an error: on a cluster a machine-local
    folder would not be visible to other executors. Only a local session may be
    given a folder by its caller (tests, bench, tools) with ``local_default``.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if local_default is None or not _is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/S3/...) so lineage cuts survive executor loss")
        conf_dir = local_default()
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint root for written tables."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, "tables", f"{name}-{uuid.uuid4().hex[:12]}")


def spread(df, min_partitions: int | None = None, key: str | None = None):
    """Repartition only when ``df`` has fewer partitions than cores.

    A source stored as one file / one row group is read by one task, which
    would serialise CPU-heavy text work (regex tokenising, cleaning). On a
    cluster reading many files the scan already has enough partitions and
    this is a no-op, so no shuffle is added at scale. Filters and column
    pruning still reach the scan below a repartition.

    With ``key`` the rows are hash-partitioned on it instead of dealt
    round-robin: every later aggregate or join keyed by it (or by it plus
    more columns) then needs no shuffle — the same plan a table bucketed on
    that key gives on a cluster.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key) if key else df.repartition(target)


def materialize(df, name: str, count: bool = False):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()`` (and survives executor loss, the
    files live on shared storage), but unlike an RDD checkpoint the result
    carries real size statistics, so the planner can still decide correctly
    which join side is small enough to broadcast.

    With ``count=True`` returns ``(frame, rows)``; the row count is observed
    during the same write job (no second pass).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if count:
        from pyspark.sql import Observation
        from pyspark.sql import functions as F
        obs = Observation(f"rows-{name}")
        df.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path), int(obs.get["n"])
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def drop_scratch(spark: SparkSession) -> bool:
    """Delete the tables this session wrote under the checkpoint folder.

    Goes through the Hadoop FileSystem of that folder, so it works for any
    shared store the cluster names (HDFS, object stores), not just local disk.
    Call it when the results that read those tables are no longer needed.
    """
    root = spark.sparkContext.getCheckpointDir()
    if not root:
        return False
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root + "/tables")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(path, True))
