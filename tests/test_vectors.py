import random

from pyspark.sql import functions as F

from tessera.operators import indexing as I
from tessera.operators import text as TX
from tessera.operators import vectors as V


import pytest


def test_dense_index_matches_python(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 50), f"w{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "n long, w string").repartition(13)
    idx = I.dense_index(df, [F.col("n").desc(), F.col("w")])
    got = {r["w"]: r["idx"] for r in idx.collect()}
    expect = {w: i for i, (n, w) in enumerate(sorted(rows, key=lambda t: (-t[0], t[1])))}
    assert got == expect


def test_vocabulary_min_count_and_order(spark):
    docs = spark.createDataFrame([(1, "b a b c"), (2, "a b a d d d")], "doc_id long, text string")
    vocab = V.build_vocabulary(TX.tokens_long(docs), min_count=2)
    got = [(r["word"], r["count"], r["idx"]) for r in vocab.orderBy("idx").collect()]
    assert got == [("a", 3, 0), ("b", 3, 1), ("d", 3, 2)]


def test_mean_embedding_rules(spark):
    docs = spark.createDataFrame(
        [(1, "x x y"), (2, "zzz"), (3, ""), (4, "x unknown")], "doc_id long, text string")
    vectors = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 4.0])], "word string, vector array<double>")
    out = {r["doc_id"]: r["features"] for r in
           V.mean_embedding(docs, TX.tokens_long(docs), vectors, 2).collect()}
    # repeated words weigh more; unknown words are not in the divisor;
    # empty and all-unknown documents get zeros
    assert out[1] == [2.0 / 3.0, 4.0 / 3.0]
    assert out[2] == [0.0, 0.0] and out[3] == [0.0, 0.0]
    assert out[4] == [1.0, 0.0]


def test_lookup_drops_unknown_keeps_repeats(spark):
    docs = spark.createDataFrame([(1, "x q x")], "doc_id long, text string")
    vectors = spark.createDataFrame([("x", [1.0])], "word string, vector array<double>")
    got = sorted(r["pos"] for r in V.lookup_word_vectors(TX.tokens_long(docs), vectors).collect())
    assert got == [0, 2]


def test_lemma_map(spark):
    words = spark.createDataFrame([(w,) for w in
                                   ["cats", "cat", "boxes", "box", "wolves", "wolf", "glass", "men", "man",
                                    "flies", "fly", "churches", "church", "s"]], "word string")
    got = {r["word"]: r["lemma"] for r in TX.noun_lemma_map(words, words).collect()}
    assert got["cats"] == "cat" and got["boxes"] == "box" and got["wolves"] == "wolf"
    assert got["flies"] == "fly" and got["churches"] == "church"
    assert got["glass"] == "glass"          # "glas" is not in the lexicon
    assert got["men"] == "men"              # same length: the word itself first
    assert got["s"] == "s"                  # an empty candidate never wins
    exc = spark.createDataFrame([("men", "man")], "word string, lemma string")
    assert {r["word"]: r["lemma"] for r in TX.noun_lemma_map(words, words, exc).collect()}["men"] == "man"


def test_total_words_after_stopwords(spark):
    docs = spark.createDataFrame([(1, "The cat and the hat"), (2, "")], "doc_id long, text string")
    toks = TX.tokens_long(docs, stop_words=["the", "and"])
    assert TX.total_words(toks).first()[0] == 2
    lists = {r["doc_id"]: r["tokens"] for r in TX.regroup_tokens(toks).collect()}
    assert lists == {1: ["cat", "hat"]}


def test_mean_vector_plugin_equals_operator(spark):
    from tessera.operators import ml as ML
    docs = spark.createDataFrame([(1, "x y x"), (2, "y")], "doc_id long, text string")
    vectors = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 3.0])], "word string, vector array<double>")
    toks = TX.tokens_long(docs)
    a = {r["doc_id"]: r["features"] for r in ML.vectorize(toks, ML.mean_vector_plugin(docs, vectors, 2)).collect()}
    b = {r["doc_id"]: r["features"] for r in V.mean_embedding(docs, toks, vectors, 2).collect()}
    assert a == b
