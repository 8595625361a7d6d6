"""Toxicity by non-negative positive-unlabelled learning.

The positives are texts confirmed as toxic, everything else is unlabelled. A
linear numpy model over words and word beginnings is fitted with the
non-negative risk estimator: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..session import materialize
from .common import fold, one_label_per_id, spread_by_hash

SAMPLE_POSITIVE = 2500  # most confirmed toxic texts that are fitted on
SAMPLE_UNLABELLED = 7500  # most unlabelled texts that are fitted on
PREFIXES = (4, 5, 6)  # word beginnings, for inflected forms
MIN_POSITIVES = 4  # texts that must have a feature, and
MIN_SHARE = 0.01  # of the positives
MIN_LIFT = 4.0  # share among positives over share among unlabelled
MAX_FEATURES = 20_000
EPOCHS = 300
RATE = 0.05
L1 = 0.03  # shrinks the weights of chance features to zero
THRESHOLD = 0.5
FOLDS, HELD_FOLD = 5, 0
_EDGE = " \t\r\n\x0b\x0c.,;:!?\"'()[]{}<>|*#$%&«»„“”‘’…-–—_"
_CACHE_WORDS = 500_000


def word_features(word: str) -> list[str]:
    w = word.strip(_EDGE)
    return [w] + ["^" + w[:k] for k in PREFIXES if len(w) > k] if len(w) > 2 else []


def text_features(text: str | set | list | None) -> set[str]:
    """The features of a text; a collection holds them already."""
    if text is not None and not isinstance(text, str):
        return set(text)
    return {f for w in set((text or "").lower().split()) for f in word_features(w)}


def select_features(positive: list, unlabelled: list, features=text_features) -> list[str]:
    """Features that stand out among the positives, strongest first."""
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
    count = Counter(f for x in positive for f in features(x))
    in_p = {f: c for f, c in count.items() if c >= max(MIN_POSITIVES, MIN_SHARE * n_p)}
    del count  # only features of some of the positives are counted further
    in_u = Counter(f for x in unlabelled for f in features(x) if f in in_p)
    lift = {f: (c / n_p) / ((in_u[f] + 1) / n_u) for f, c in in_p.items()}
    good = [f for f, x in lift.items() if x >= MIN_LIFT]
    return sorted(good, key=lambda f: (-in_p[f] * np.log(lift[f]), f))[:MAX_FEATURES]


def _design(rows: list, number: dict[str, int], features) -> np.ndarray:
    """Row numbers and feature numbers of the ones of a 0/1 matrix."""
    at = [(i, number[f]) for i, x in enumerate(rows) for f in features(x) if f in number]
    return np.array(at, np.int64).reshape(-1, 2).T


def fit_nnpu(positive: list, unlabelled: list, prior: float, features=text_features,
             epochs: int = EPOCHS, rate: float = RATE, l1: float = L1) -> tuple[dict[str, float], float]:
    """(weights by feature, bias) minimising the non-negative risk with the
    logistic loss by proximal Adam steps. While the negative part of the risk is below zero,
    the step goes up its gradient instead, as the estimator prescribes."""
    names = select_features(positive, unlabelled, features)
    number = {f: i for i, f in enumerate(names)}
    if not positive or not unlabelled or not names:
        return {}, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    (pr, pc), (ur, uc) = _design(positive, number, features), _design(unlabelled, number, features)
    w, m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    n_p, n_u, d = len(positive), len(unlabelled), len(names)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    back = lambda g, r, c: np.append(np.bincount(c, g[r], d), g.sum())
    for t in range(1, epochs + 1):
        zp = np.bincount(pr, w[pc], n_p) + w[-1]
        zu = np.bincount(ur, w[uc], n_u) + w[-1]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_neg = back(sigmoid(zu) / n_u, ur, uc) - prior * back(sigmoid(zp) / n_p, pr, pc)
        g_pos = prior * back((sigmoid(zp) - 1) / n_p, pr, pc)
        g = g_pos + g_neg if negative >= 0 else -g_neg
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * l1, 0)
    return {f: x for f, x in zip(names, w[:-1].tolist()) if x}, float(w[-1])


def _common_features(sample: DataFrame) -> set[str]:
    """sample(y, f) -> at most ``MAX_FEATURES`` features that :func:`select_features`
    can choose, counted by Spark."""
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    counts = sample.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("u"))
    lift = (F.col("p") / n_p) / ((F.col("u") + 1) / n_u)
    often = counts.where(F.col("p") >= max(MIN_POSITIVES, MIN_SHARE * n_p)).where(lift >= MIN_LIFT)
    return {r.f for r in often.orderBy(F.desc(F.col("p") * F.log(lift)), "f").select("f").limit(MAX_FEATURES).collect()}


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD_FOLD) -> tuple[dict[str, float], float]:
    """The model from the rows of ``labels(doc_id, toxic)`` outside the held-out
    fold. The class prior is the share of toxic among these rows. Both samples
    are the first ids by a hash, at most ``SAMPLE_POSITIVE`` and
    ``SAMPLE_UNLABELLED``, with texts of any length; of repeated ids up to twice as
    many texts count, equal texts once. Features are found and counted in tasks; the
    driver gets those of each text that the model may use."""
    known = one_label_per_id(labels, "toxic", F.max).where(~fold(F.col("doc_id"), folds, held))
    got = known.agg(F.avg((F.col("label") > 0).cast("double")).alias("prior")).first()
    prior = min(0.9, max(0.001, got.prior or 0.001))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    toxic = known.where("label > 0").orderBy(spread_by_hash(1), "doc_id").limit(SAMPLE_POSITIVE).select("doc_id")
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~fold(F.col("doc_id"), folds, held))
    some = ids.distinct().orderBy(spread_by_hash(2), "doc_id").limit(SAMPLE_UNLABELLED)

    @arrow_udf("array<string>")
    def found(whole: pa.Array) -> pa.Array:
        return pa.array([sorted(text_features(t)) for t in whole.to_pylist()], pa.list_(pa.string()))

    def sampled(wanted: DataFrame, y: int) -> DataFrame:
        rows = texts.join(wanted, "doc_id", "left_semi").withColumn("h", F.xxhash64("text"))
        # equal positives are one text, whatever their ids
        keys = rows.groupBy("h").agg(F.min("doc_id").alias("doc_id")) if y else rows.select("h", "doc_id").distinct()
        most = 2 * (SAMPLE_POSITIVE if y else SAMPLE_UNLABELLED)
        keys = keys.orderBy(spread_by_hash(1), "doc_id", "h").limit(most)
        return (rows.join(keys, ["doc_id", "h"], "left_semi").select(F.lit(y).alias("y"), "doc_id", "h", found("text").alias("f"))
                .dropDuplicates(["doc_id", "h"]))
    sample = materialize(sampled(toxic, 1).unionAll(sampled(some, 0)), "toxicity-sample")
    names = _common_features(sample)

    @arrow_udf("array<string>")
    def used(rows: pa.Array) -> pa.Array:
        return pa.array([[f for f in r if f in names] for r in rows.to_pylist()], pa.list_(pa.string()))

    rows = sample.select("y", "doc_id", "h", used("f").alias("f")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.h))
    return fit_nnpu([r.f for r in rows if r.y], [r.f for r in rows if not r.y], prior)


def score_column(text: Column, weights: dict[str, float], bias: float) -> Column:
    """Probability that a whole text is toxic (null or empty: no word counts)."""
    @arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        known: dict[str, float] = {}
        out = np.empty(len(texts))
        for i, text in enumerate(texts.to_pylist()):
            total, seen = bias, set()
            for w in set((text or "").lower().split()):
                hit = known.get(w)
                if hit is None:
                    if len(known) >= _CACHE_WORDS:
                        known.clear()
                    hit = known[w] = tuple(f for f in word_features(w) if f in weights)
                if hit:
                    seen.update(hit)
            total += sum(weights[f] for f in sorted(seen))
            out[i] = 1 / (1 + np.exp(-min(30.0, max(-30.0, total))))
        return pa.array(out)
    return scores(text.cast("string"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD_FOLD,
                    threshold: float = THRESHOLD) -> DataFrame:
    """documents -> (doc_id, held_out, score, predicted), one row per input row.

    Labels outside the held-out fold teach the model; language, source and id
    never enter a score. Null and empty texts get the score of a text without
    any known word. Repeated rows are scored each time, repeated labels count
    as toxic if any is. Without labels or documents the prior is the score; an
    empty table gives an empty table.
    """
    weights, bias = fit(docs, labels, folds, held)
    return (docs.select("doc_id", fold(F.col("doc_id"), folds, held).alias("held_out"), "text")
            .select("doc_id", "held_out", score_column(F.col("text"), weights, bias).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
