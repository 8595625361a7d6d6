"""Label lists: gather, dictionary, encode, statistics, padding, pair explosion.

Long form ``(doc_id, label)`` is the exchange format; list form
``(doc_id, labels ARRAY)`` is built only where a list is the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..session import materialize
from .indexing import dense_index


def labels_by_id(ids: DataFrame, links: DataFrame, id_col: str = "doc_id",
                 label_col: str = "label", out_col: str = "labels") -> DataFrame:
    """Every id with the sorted list of its labels; ``[]`` when it has none.

    One left join + group; ``collect_list`` skips the nulls of unmatched ids.
    """
    keys = ids.select(id_col).distinct()
    lab = links.select(id_col, label_col)
    return (keys.join(lab, id_col, "left")
                .groupBy(id_col)
                .agg(F.array_sort(F.collect_list(label_col)).alias(out_col)))


def label_dictionary(links: DataFrame, id_col: str = "doc_id", label_col: str = "label",
                     code_col: str = "code") -> DataFrame:
    """Distinct labels with dense codes from 0 in first-seen order.

    First seen = ordered by (smallest document id holding it, label), which is
    stable between runs.
    """
    first = links.groupBy(label_col).agg(F.min(id_col).alias("_first"))
    return (dense_index(first, [F.col("_first"), F.col(label_col)], "_idx")
            .select(label_col, F.col("_idx").cast("int").alias(code_col)))


def encode_labels(lists: DataFrame, codes: DataFrame, id_col: str = "doc_id",
                  labels_col: str = "labels", label_col: str = "label",
                  code_col: str = "code", out_col: str = "codes") -> DataFrame:
    """Replace each label of each list by its code, keeping list order.

    Documents with an empty list keep ``[]``. Labels missing from the code
    table are dropped (the dictionary lookup of the original returns nothing
    useful for them).
    """
    ex = lists.select(id_col, F.posexplode_outer(labels_col).alias("_pos", label_col))
    joined = ex.join(codes.select(label_col, code_col), label_col, "left")
    item = F.when(F.col(code_col).isNotNull(), F.struct(F.col("_pos"), F.col(code_col)))
    return (joined.groupBy(id_col)
                  .agg(F.array_sort(F.collect_list(item)).alias("_s"))
                  .select(id_col, F.transform("_s", lambda s: s[code_col]).alias(out_col)))


def count_labels(codes: DataFrame, label_col: str = "label") -> DataFrame:
    return codes.agg(F.count_distinct(label_col).cast("long").alias("n_labels"))


def label_list_stats(lists: DataFrame, codes_col: str = "codes") -> DataFrame:
    """Number of (document, label) pairs, the longest list and the mean length."""
    n = F.size(codes_col)
    return lists.agg(F.sum(n).cast("long").alias("n_samples"),
                     F.max(n).cast("long").alias("max_len"),
                     F.avg(n).alias("mean_len"))


def max_list_length(lists: DataFrame, codes_col: str = "codes") -> Column:
    """Longest list as a scalar subquery (computed once, no join)."""
    return lists.select(F.coalesce(F.max(F.size(codes_col)), F.lit(0))).scalar()


def pad_label_list(lists: DataFrame, codes_col: str = "codes", out_col: str = "padded",
                   pad_value: int = P.PAD_VALUE, max_len: Column | None = None) -> DataFrame:
    """Right-pad each list with ``pad_value`` up to the longest list. The lists are
    stored first, so that the longest is found without making them again."""
    if max_len is None:
        lists = materialize(lists, "label-lists")
    m = max_list_length(lists, codes_col) if max_len is None else max_len
    fill = F.array_repeat(F.lit(pad_value), m - F.size(codes_col))
    return lists.withColumn(out_col, F.concat(F.col(codes_col), fill))


def explode_pairs(lists: DataFrame, codes_col: str = "codes", pos_col: str = "pos",
                  label_col: str = "code") -> DataFrame:
    """One row per (document, label) in list order; empty lists give no rows."""
    others = [c for c in lists.columns]
    return lists.select(*others, F.posexplode(codes_col).alias(pos_col, label_col))
