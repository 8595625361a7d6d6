"""Documents met by block: what is shuffled, and results on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as FT
from tessera.operators import linear as LN
from tessera.operators import ml as ML
from tessera.operators import text as TX
from tessera.operators import vectors as V
from tessera.plans import queries as Q


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _wide(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("cats cat runs w"), (F.col("id") % 7).cast("string")).alias("text"))


def test_means_shuffle_no_vector_per_term(spark):
    docs = _wide(spark, 100)
    vectors = spark.createDataFrame([("cat", [1.0, 2.0])], "word string, vector array<double>")
    plan = _plan(V.mean_embedding(docs, TX.tokens_long(docs), vectors, 2))
    # neither vectors of single terms nor partial sums by document are aggregated
    assert "ObjectHashAggregate" not in plan and "MapInArrow" in plan


def test_means_match_brute_force_on_odd_rows(spark):
    rnd = np.random.default_rng(3)
    ids = [None, 1, 1, *range(2, 60)]
    tf = [(i, f"w{w}", float(rnd.integers(1, 4))) for i in [*ids, 999] for w in rnd.integers(0, 30, 6)]
    tf.append((5, None, 2.0))
    table = [(f"w{w}", [float(x) for x in rnd.normal(size=3)]) for w in [*range(20), 4, 4]] + [(None, [9.0] * 3)]
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id long").repartition(5)
    out = V.mean_embedding_tf(docs, spark.createDataFrame(tf, "doc_id long, word string, tf double").repartition(7),
                              spark.createDataFrame(table, "word string, vector array<double>")).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(map(str, ids))
    for r in out:
        met = [(t, v) for i, w, t in tf for x, v in table if i is not None and i == r["doc_id"] and w is not None and w == x]
        want = sum(t * np.array(v) for t, v in met) / sum(t for t, _ in met) if met else np.zeros(3)
        assert np.allclose(r["features"], want)


def _by_texts(docs, vectors, blocks=None):
    blocks = blocks or V.text_blocks(docs)
    return V.mean_embedding_texts(docs, FT.tokenize, vectors, V.word_counts_by_block(docs, FT.tokenize, blocks), blocks)


def test_text_means_shuffle_texts_and_single_precision(spark):
    vectors = spark.createDataFrame([("cat", [1.0, 2.5])], "word string, vector array<double>")
    out = _by_texts(_wide(spark, 100), vectors)
    moved = [x for x in _plan(out).splitlines() if "REPARTITION_BY" in x]
    assert moved and "Sort [_kind" in _plan(out) and "_word ASC" not in _plan(out)  # no sort of terms
    assert "regexp_extract_all" in _plan(out).split("Sort [_kind")[0]  # cut into words after the shuffle
    assert "array<float>" in _plan(out)
    assert {tuple(r["features"]) for r in out.collect()} == {(1.0, 2.5)}


@pytest.mark.parametrize("blocks", [1, 3])
@pytest.mark.parametrize("exact", [True, False])
def test_text_means_match_brute_force_on_odd_rows(spark, blocks, exact):
    rnd = np.random.default_rng(4)
    ids = [None, None, 1, 1, 1, *range(2, 60)]
    texts = [" ".join(f"w{w}" for w in rnd.integers(0, 30, rnd.integers(0, 9))) for _ in ids]
    texts[5:8] = None, "", "unknown words"
    numbers = [float(np.float32(x)) if exact or w % 2 else float(x) for w, x in enumerate(rnd.normal(size=66))]
    table = [(f"w{w}", numbers[3 * i:3 * i + 3]) for i, w in enumerate([*range(20), 4, 4])] + [(None, [9.0] * 3)]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # rows of an id in several batches
    try:
        out = _by_texts(docs, spark.createDataFrame(table, "word string, vector array<double>"), blocks).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(str(r["doc_id"]) for r in out) == sorted(map(str, ids))
    for r in out:
        met = [v for i, t in zip(ids, texts) if i is not None and i == r["doc_id"] and t for w in t.split() for x, v in table if w == x]
        assert np.allclose(r["features"], np.mean(met, axis=0) if met else np.zeros(3), atol=1e-14)


def test_text_means_without_vectors_or_documents(spark):
    vectors = spark.createDataFrame([("cat", [1.0, 2.0])], "word string, vector array<double>")
    assert {tuple(r["features"]) for r in _by_texts(_wide(spark, 9), vectors.where("word = 'x'")).collect()} == {()}
    assert _by_texts(_wide(spark, 9).limit(0), vectors).count() == 0


def test_blocks_follow_the_bytes_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_TEXT", 1000)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 136).alias("text"))
    assert V.text_blocks(docs) == 40 and V.text_blocks(docs.limit(0)) == V.LEAST_BLOCKS


def test_words_are_counted_without_moving_tokens(spark):
    docs = _wide(spark, 100)
    plan = _plan(V.term_frequencies(TX.tokens_long(V.by_document(docs))))
    assert plan.count("Exchange") == 1 and "hashpartitioning(doc_id" in plan


def test_frequent_word_is_cut_into_blocks(spark):
    docs = _wide(spark, 500)
    vectors = spark.createDataFrame([("cat", [1.0]), ("w3", [2.0])], "word string, vector array<double>")
    tokens = TX.tokens_long(docs)
    got = V.lookup_word_vectors(tokens, vectors)
    plan = _plan(got)
    assert "ShuffledHashJoin" in plan and "_block" in plan
    want = tokens.where("word in ('cat', 'w3')")
    assert got.select("doc_id", "pos", "word").exceptAll(want).count() == 0 and got.count() == want.count()


def test_changed_lemmas_are_the_lemmas_that_differ(spark):
    words = spark.createDataFrame([(w,) for w in ["cats", "cat", "boxes", "box", "glass", "men", "man", "s", "wolves", "wolf", "runs"]], "word string")
    every = {r["word"]: r["lemma"] for r in TX.noun_lemma_map(words, words, distinct=True).collect()}
    changed = {r["word"]: r["lemma"] for r in TX.changed_lemmas(words, words).collect()}
    assert changed == {w: x for w, x in every.items() if w != x} and changed["cats"] == "cat"


def test_tfidf_moves_texts_once_and_terms_once(spark):
    docs = _wide(spark, 60)
    feats = ML.vectorize(TX.tokens_long(V.by_document(docs)), ML.tfidf_plugin(docs))
    assert "hashpartitioning(doc_id" in _plan(feats)  # counted from the texts, not read back
    assert {(r["word"], r["tf"]) for r in feats.where("doc_id = 3").collect()} == {("cats", 1.0), ("cat", 1.0), ("runs", 1.0), ("w3", 1.0)}


@pytest.mark.parametrize("rows", [0, 3, 2500])
def test_single_block_layer_is_one_python_step(spark, rows):
    rnd = np.random.default_rng(5)
    x, w = rnd.normal(size=(rows, 4)), rnd.normal(size=(3, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(rows, None), (rows + 1, [1.0])], "id long, features array<double>")
    weights = spark.createDataFrame([(u, w[u].tolist(), float(u)) for u in range(3)], "unit int, w array<double>, b double")
    out = LN.dense_layer(df, weights, "features", "h", activation="tanh")
    plan = _plan(out)
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    got = {r["id"]: r["h"] for r in out.collect()}
    assert len(got) == rows + 2 and got[rows] is None and got[rows + 1] is None
    assert all(np.allclose(got[i], np.tanh(x[i] @ w.T + np.arange(3))) for i in range(rows))


def test_stored_vectors_are_computed_once(spark, monkeypatch, tmpdir_path):
    _wide(spark, 30).write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(4)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmpdir_path}/embeddings.parquet")
    seen = []
    monkeypatch.setattr(Q.VS, "write_vectors", lambda vectors, path: seen.append(vectors))
    Q._stored_vectors(spark, tmpdir_path)
    # dealing by ranges reads its input twice: it must not be the mean step
    assert "MapInArrow" not in _plan(seen[0]) and seen[0].count() == 30
