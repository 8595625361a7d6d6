"""Wiki markup whose marks nest: one row per mark, depths by running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def drop_balanced(docs: DataFrame, marks: str, opens: str, width: int) -> DataFrame:
    """docs(doc_id, text) without what stands between balanced marks.

    ``marks`` finds opening and closing marks, ``opens`` is part of the opening
    ones only, ``width`` the characters of one mark where a run of them counts as
    several (0: a match is one mark). The depth after each mark is a running sum
    that never falls below zero, so closing marks without an opening one stay in
    the text. A part goes if the depth falls under its own later on; opening
    marks that nothing closes stay. Linear in the marks of a text, however deep
    they nest; one shuffle by doc_id, which has to be unique. Null texts stay null.
    """
    text = F.col("text")
    parts = F.arrays_zip(F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(marks), F.lit(0))).alias("mark"),
                         F.split(text, marks).alias("part"))
    rows = docs.select("doc_id", F.posexplode_outer(parts).alias("at", "x")).select("doc_id", "at", "x.mark", "x.part")
    size = F.floor(F.length("mark") / width) if width else F.lit(1)
    rows = rows.withColumn("w", F.when(F.col("mark") == "", 0).when(F.contains("mark", F.lit(opens)), size).otherwise(-size))
    forward = Window.partitionBy("doc_id").orderBy("at")
    backward = Window.partitionBy("doc_id").orderBy(F.desc("at"))
    rows = rows.withColumn("sum", F.sum("w").over(forward))
    rows = rows.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(forward)))
    rows = rows.withColumn("before", F.lag("depth", 1, 0).over(forward))
    rows = rows.withColumn("floor", F.min("depth").over(backward))
    # levels of a mark that have no partner: they are text
    left = F.when(F.col("w") > 0, F.greatest(F.lit(0), F.least(F.col("w"), F.col("floor") - F.col("before")))).otherwise(
        F.abs("w") - (F.col("before") - F.col("depth")))
    shown = F.when(left == F.abs("w"), F.col("mark")).otherwise(F.substring(F.col("mark"), F.lit(1), (left * width).cast("int")))
    piece = F.concat(shown, F.when(F.col("depth") > F.col("floor"), "").otherwise(F.col("part")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "")
    return (rows.withColumn("piece", piece).groupBy("doc_id").agg(joined.alias("text"), F.max("at").alias("last"))
            .select("doc_id", F.when(F.col("last").isNotNull(), F.col("text")).alias("text")))


def links_to_text(text: Column) -> Column:
    """Links to the text after their last bar, the inner ones first."""
    return F.aggregate(F.sequence(F.lit(0), T.nesting(text, P.WIKI_LINK_MARK, "[[")), text,
                       lambda t, i: F.when(i > 0, F.regexp_replace(t, P.WIKI_INNER_LINK, "$1")).otherwise(t))


def wiki_documents_to_plain(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as wiki markup -> (doc_id, plain). Templates and tables
    are dropped whatever stands nested in them, links with linked captions become
    their text, marks without a partner stay, all character references are
    decoded. doc_id is unique; null texts stay null, an empty table stays empty."""
    c = F.col("text")
    for pattern in P.WIKI_DROP:
        c = F.regexp_replace(c, pattern, "")
    rows = drop_balanced(docs.select("doc_id", c.alias("text")), P.WIKI_TEMPLATE_RUN, "{{", 2)
    rows = drop_balanced(rows, P.WIKI_TABLE_MARK, "{|", 0)
    # a projection of its own: the decoding names its text several times
    rows = rows.select("doc_id", T.wiki_inline(links_to_text(F.col("text"))).alias("text"))
    return rows.select("doc_id", T.decode_references("text").alias("plain"))
