"""Property checks for the queries without an SQL oracle."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001
from tessera.plans import fixtures as FX
from tessera.plans import ml_queries as MQ


def test_word_vectors_vocabulary_equals_counted_vocabulary(spark):
    r = E.queries()["train_word_vectors"](spark, SF001).first()
    assert r["vocabulary_matches"] and r["dims"] == 200 and r["n_words"] > 0


def test_logistic_beats_prior_and_reload_is_equal(spark):
    assert E.queries()["train_logistic"](spark, SF001).first()["below_prior_loss"]
    same = E.queries()["save_model"](spark, SF001)
    assert same.filter(~F.col("same_prediction")).count() == 0 and same.count() > 0


def numpy_conv_net(features, convs, hidden, output):
    preds = []
    for x in features:
        maps = [np.asarray(x, dtype=float)]
        for filters, pool in convs:
            out = []
            for w, b in filters:
                k, width = len(w[0]), len(maps[0])
                conv = np.array([sum(np.dot(maps[m][i:i + k], np.asarray(w[m])[::-1]) for m in range(len(maps)))
                                 for i in range(width - k + 1)])
                n_out = (width - k + 1) // pool
                out.append(np.tanh(np.array([conv[q * pool:(q + 1) * pool].max() for q in range(n_out)]) + b))
            maps = out
        flat = np.concatenate(maps)
        h = np.tanh(np.array([np.dot(flat, w) + b for w, b in hidden]))
        preds.append(int(np.argmax(np.array([np.dot(h, w) + b for w, b in output]))))
    return np.array(preds)


def test_conv_net_matches_numpy(spark):
    emb = FX.embedding_rows(spark, SF001).orderBy("vec_id")
    convs, hidden, output = MQ.conv_net_weights(spark, SF001)

    def rows(df, nested):
        out = []
        for r in df.orderBy("unit").collect():
            w = [list(m) for m in r["w"]] if nested else list(r["w"])
            out.append((w, r["b"]))
        return out

    np_convs = [(rows(f, True), pool) for f, pool in convs]
    feats = np.array([r["features"] for r in emb.collect()])
    expect = numpy_conv_net(feats, np_convs, rows(hidden, False), rows(output, False))
    got = [r["pred"] for r in E.queries()["score_conv_net"](spark, SF001).orderBy("vec_id").collect()]
    assert got == expect.tolist()
