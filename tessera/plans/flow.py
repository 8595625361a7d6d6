"""The whole flow as queries: cleaned text -> stop words -> noun lemmas -> word
vectors -> mean vectors -> pairs -> fit on the train split -> saved and loaded
model -> report on the test split."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import batching as B
from ..operators import evaluate as E
from ..operators import labels as L
from ..operators import markup as MK
from ..operators import ml as ML
from ..operators import text as TX
from ..operators import vectors as V
from ..session import materialize, scratch_path
from ..sinks import writers as W
from . import fixtures as FX

MAX_ITER = 20  # optimiser steps of the fit; a parameter of the result
MAX_DEPTH = 6  # deepest template nesting of the wiki fixture


def _lemma_tf(spark, sf):
    """``(doc_id, word, tf)`` of lemmas. Term frequencies, not tokens, go
    through the lemma map, so a frequent word is one row per document there."""
    docs = FX.table(spark, sf, "documents").select("doc_id", "text")
    def tokens(texts):
        return TX.tokens_long(TX.clean_documents(texts), stop_words=P.ENGLISH_STOP_WORDS)
    tf = V.term_frequencies(tokens(V.by_document(docs)))
    words = materialize(tokens(docs).select("word").distinct(), "flow-words")
    lemmas = materialize(TX.changed_lemmas(words, words), "flow-lemmas")
    return TX.lemmatize_long(tf, lemmas).groupBy("doc_id", "word").agg(F.sum("tf").alias("tf"))


def flow_lemma_tokens(spark, sf):
    return _lemma_tf(spark, sf).select("doc_id", "word", F.col("tf").cast("long").alias("n"))


def flow_train_evaluate(spark, sf):
    docs = FX.table(spark, sf, "documents").select("doc_id")
    tf = materialize(_lemma_tf(spark, sf), "flow-lemma-tf")
    w1 = FX.word_vectors(spark, sf, V.vocabulary_from_counts(V.counts_from_tf(tf)))
    vectors = V.mean_embedding_tf(docs, tf, w1)
    links = FX.label_links(spark, sf)
    codes = L.encode_labels(L.labels_by_id(docs, links), L.label_dictionary(links))
    rows = materialize(B.train_test_split(V.attach_label_list(vectors, codes)), "flow-rows")
    pairs = L.explode_pairs(rows.filter(F.col("split") == "train")).select("features", F.col("code").cast("double").alias("label"))
    model = ML.train_logistic(pairs, max_iter=MAX_ITER)
    path = scratch_path(spark, "flow-model")
    ML.save_model(model, path)
    history = [("logistic", i, "loss", float(x)) for i, x in enumerate(model.summary.objectiveHistory)]
    # the loss by iteration is a run's metric history; its length is bounded by MAX_ITER
    W.write_metrics(spark.createDataFrame(history, "run string, iteration long, metric string, value double"), scratch_path(spark, "flow-metrics"))
    loaded = ML.load_model(LogisticRegressionModel, path)
    scored = ML.model_predict(loaded, rows.filter(F.col("split") == "test")).withColumn("pred", F.col("prediction").cast("int"))
    report = E.evaluate_pairs(scored)
    train = rows.filter(F.col("split") == "train")
    return report.select(
        train.select(F.count(F.lit(1))).scalar().alias("n_train_docs"),
        train.select(F.sum(F.size("codes"))).scalar().cast("long").alias("n_train_pairs"),
        F.col("n_docs").alias("n_test_docs"), F.col("n_pairs").alias("n_test_pairs"),
        F.lit(history[-1][-1] < history[0][-1]).alias("loss_fell"), F.col("doc_error").between(0, 1).alias("error_is_a_share"))


def wiki_text(spark, sf):
    """Fixture: each whole document as wiki markup with templates nested 1 to
    ``MAX_DEPTH`` deep."""
    depth = (F.col("doc_id") % MAX_DEPTH + 1).cast("int")
    text = F.concat(F.lit("== "), "lang", F.lit(" ==\n'''Bold''' [[page|"), "source", F.lit("]] [[plain]] "),
                    F.repeat(F.lit("{{t|"), depth), "lang", F.repeat(F.lit(" }}"), depth), F.lit("<ref>gone</ref> "), "text")
    return FX.table(spark, sf, "documents").select("doc_id", text.alias("text"))


def wiki_to_plain(spark, sf):
    return wiki_text(spark, sf).select("doc_id", T.wiki_to_plain("text").alias("plain"))


def wiki_nested_text(spark, sf):
    """Fixture: each whole document as wiki markup with tables and templates in
    one another, a linked caption, character references and marks left open."""
    i = F.col("doc_id")
    depth = (i % MAX_DEPTH + 1).cast("int")
    text = F.concat(F.repeat(F.lit("{{t|"), depth), "lang", F.repeat(F.lit("}}"), depth),
                    F.lit("\n"), F.repeat(F.lit("{| out\n| a {{cell\n|}}\n"), depth), "lang", F.repeat(F.lit("\n|}\n"), depth),
                    F.lit("[[File:x.png|thumb|seen [[page|"), "source", F.lit("]] here]] caf&eacute; &#233;&#x1F642; &nosuch; &amp;lt; "),
                    F.when(i % 3 == 0, "{{left [[open ").otherwise("]] }} "), F.when(i % 5 == 0, "\n{| open\n").otherwise("\n|}\n"),
                    "text", F.when(i % 4 == 0, " }} ]] ").otherwise(""))
    return FX.table(spark, sf, "documents").select("doc_id", text.alias("text"))


def wiki_nested_to_plain(spark, sf):
    return MK.wiki_documents_to_plain(wiki_nested_text(spark, sf))


def registry():
    return {"flow_lemma_tokens": flow_lemma_tokens, "flow_train_evaluate": flow_train_evaluate, "wiki_to_plain": wiki_to_plain,
            "wiki_nested_to_plain": wiki_nested_to_plain}
