"""Physical-plan properties that matter at scale."""

import pytest

import __spark_entry__ as E
from conftest import SF001
from tessera.plans import queries as Q

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")
# model fitting and persistence run MLlib; every other of the reference's own
# operators must stay plain SQL; the training-data operators choose their style and have their own tests
SKIP = {"train_word_vectors", "train_logistic", "train_mlp", "save_model"}


def executed_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(Q.registry()) - SKIP))
def test_no_cartesian_or_python(spark, name):
    plan = executed_plan(E.queries()[name](spark, SF001))
    assert not [k for k in FORBIDDEN if k in plan], plan


def test_point_lookup_pushed_to_scan(spark):
    plan = executed_plan(E.queries()["get_doc_by_id"](spark, SF001))
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,42)]" in plan


def test_scan_reads_only_used_columns(spark):
    plan = executed_plan(E.queries()["tokenize"](spark, SF001))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = executed_plan(E.queries()["semi_join_ids"](spark, SF001))
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan


def test_keyset_paging_is_top_k(spark):
    plan = executed_plan(E.queries()["take_batch"](spark, SF001))
    assert "TakeOrderedAndProject" in plan and "GreaterThan(doc_id,100)" in plan


def test_bucketed_documents_need_no_shuffle_per_document(spark, tmpdir_path):
    import os

    from tessera.operators import text as TX
    from tessera.operators import vectors as V
    from tessera.plans import fixtures as FX
    from tessera.sinks import writers as W

    docs = FX.table(spark, SF001, "documents").select("doc_id", "text")
    W.write_documents_bucketed(docs, "docs_bucketed", 4, path=os.path.join(tmpdir_path, "docs_b"))
    stored = spark.table("docs_bucketed")
    tf = V.term_frequencies(TX.tokens_long(stored))
    plan = executed_plan(tf)
    assert "Exchange" not in plan, plan
    assert tf.count() > 0


def test_spread_adds_no_shuffle_to_a_wide_scan(spark, tmpdir_path):
    import os

    from tessera.session import spread
    path = os.path.join(tmpdir_path, "wide")
    spark.range(4000).withColumnRenamed("id", "doc_id").repartition(16).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")   # many read partitions
    try:
        wide = spark.read.parquet(path)
        assert "Exchange" not in executed_plan(spread(wide, min_partitions=8))
        narrow = spark.read.parquet(path).coalesce(1)
        plan = executed_plan(spread(narrow, min_partitions=8, key="doc_id"))
        assert "hashpartitioning(doc_id" in plan
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
