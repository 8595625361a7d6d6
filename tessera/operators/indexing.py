"""Dense 0-based index over a total order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits

def dense_index(df: DataFrame, order_cols, index_col: str = "idx") -> DataFrame:
    """Append ``index_col`` = 0-based rank of each row in ``order_cols`` order.

    ``order_cols`` must be a total order (add a unique tie-breaker) for the
    result to be deterministic.

    One plan for every size, in which no task ever gets all rows:
    a range-partitioned sort (distributed), then each row is tagged with
    its sort partition id and in-partition row number, and the tagged rows
    are written once to the shared checkpoint folder. Both later passes read
    the stored tags, so they agree however the files are split on reading,
    and a lost executor cannot change the numbering. The per-partition
    counts are one row per sort partition (bounded by the partition count,
    never by the data), so their prefix sums run in one small task and are
    broadcast back.
    """
    cols = df.columns
    tagged = materialize(df.orderBy(*order_cols)
                         .select("*", F.spark_partition_id().alias("_pid"),
                                 F.monotonically_increasing_id().alias("_mid")),
                         "dense-index")
    prior = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
                     .select("_pid", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_off")))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), _ROW_BITS)
    return (tagged.join(F.broadcast(offsets), "_pid")
                  .select(*[F.col(c) for c in cols], (F.col("_off") + local).alias(index_col)))
