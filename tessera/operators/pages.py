"""Row selection on documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def get_doc_by_id(docs: DataFrame, doc_id, id_col: str = "doc_id") -> DataFrame:
    """Point lookup; the predicate reaches the Parquet scan (row-group skipping)."""
    return docs.filter(F.col(id_col) == F.lit(doc_id))


def semi_join_ids(pages: DataFrame, ids: DataFrame, page_id_col: str = "id",
                  ids_col: str | None = None) -> DataFrame:
    """Keep pages whose id is in ``ids``. The id set is not assumed small:
    AQE broadcasts it only when its measured size is under the threshold."""
    ids_col = ids_col or ids.columns[0]
    keys = ids.select(F.col(ids_col).alias("_k"))
    return pages.join(keys, pages[page_id_col] == keys["_k"], "left_semi")


def drop_incomplete(df: DataFrame, cols) -> DataFrame:
    return df.dropna(subset=list(cols))
