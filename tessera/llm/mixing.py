"""Mixing to target weights with soft domain membership.

A naive Bayes classifier, counted from a labelled table, gives every document a
posterior over the domains. Nonnegative document rates are then fitted so that
the expected tokens of each domain match its target: projected gradient steps on
the squared differences, with one aggregate over all documents per step. All of
it is DataFrame functions; the driver sees sums by domain only.
"""

from __future__ import annotations

import warnings
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import packed, row_key

SAMPLE_LABELLED = 4000  # most labelled documents that the classifier is counted from
VOCABULARY = 4000  # words that tell domains apart best; bounds the broadcast table and the filter's set
MIN_DOCS = 5  # labelled documents with a word of the vocabulary
MIN_LIFT, MIN_SHARE = 3.0, 0.01  # a word's share in a domain over that in all, and in the domain
SMOOTHING = 0.5
STEM = 5  # characters of a word that count, so that inflected forms are one
TEMPER = 0.5  # scales the words' evidence, which naive Bayes counts as independent
MAX_STEPS = 20
STALLS = 3  # steps in a row that gain under 0.01 %, after which the fit ends
TOLERANCE = 1e-6  # of all target tokens: so near the targets the fit is done
OFF = 1e-3  # of all target tokens: further off, a warning says so
STILL = 1e-4  # of all tokens: a gradient step that moves less shows that no rates come nearer
RIDGE = 1e-9
_SPACE = "[ \\t\\n\\x0B\\f\\r]+"
_DOC = "#doc"  # stands in every document; carries the prior


def _rows(docs: DataFrame, *keep: str, among: list[str] | None = None) -> DataFrame:
    """The columns ``keep``, ``n_tokens`` (words of the lower-cased text) and
    ``tokens``: distinct word beginnings, of those in ``among`` if that is given,
    and marks for length, symbols and capitals. One projection after the other,
    so that none is computed twice."""
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(*keep, "text", F.array_remove(F.split(F.lower("text"), _SPACE), "").alias("words"))
    stem = lambda w: F.substring(w, 1, STEM)
    known = F.col("words") if among is None else F.filter("words", lambda w: stem(w).isin(among))
    rows = rows.select(*keep, F.size("words").cast("bigint").alias("n_tokens"), F.length("text").alias("n"),
                       F.regexp_count("text", F.lit("[#*$%&|<>!]")).alias("symbols"),
                       F.regexp_count("text", F.lit("[A-Z]")).alias("capitals"), known.alias("known"))
    mark = lambda name, value: F.concat(F.lit(f"#{name} "), F.floor(value).cast("string"))
    marks = F.array(F.lit(_DOC), mark("length", F.log2(F.col("n_tokens") + 1)),
                    mark("symbols", 20 * F.col("symbols") / (F.col("n") + 1)), mark("capitals", 20 * F.col("capitals") / (F.col("n") + 1)))
    return rows.select(*keep, "n_tokens", F.concat(marks, F.array_distinct(F.transform("known", stem))).alias("tokens"))


def learn_words(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """(token, w_0 .. w_k): the evidence of each vocabulary word for each domain,
    and the log priors under ``_DOC``. Counted from the first ``SAMPLE_LABELLED``
    ids of ``labelled(doc_id, domain)`` by hash."""
    known = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
    known = known.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_LABELLED)
    rows = _rows(docs.select("doc_id", "text").join(some, "doc_id"), "doc_id", "domain")
    is_in = [F.count_if(F.col("domain") == d).alias(f"c_{i}") for i, d in enumerate(domains)]
    counts = rows.select("domain", F.explode_outer("tokens").alias("token")).groupBy("token").agg(*is_in)
    n_c = [F.col(f"c_{i}") for i in range(len(domains))]
    counts = materialize(counts.where(sum(n_c) >= MIN_DOCS), "mix-counts")
    sizes = counts.where(F.col("token") == _DOC).first()
    size = [float(sizes[f"c_{i}"]) if sizes else 0.0 for i in range(len(domains))]
    total = max(1.0, sum(size))
    rate = [(c + SMOOTHING) / F.lit(s + 2 * SMOOTHING) for c, s in zip(n_c, size)]
    whole = (sum(n_c) + SMOOTHING) / F.lit(total + 2 * SMOOTHING)
    gain = sum(c * F.log(r / whole) for c, r in zip(n_c, rate))
    tells = [(r / whole >= MIN_LIFT) & (c >= max(MIN_DOCS, MIN_SHARE * s)) for r, c, s in zip(rate, n_c, size)]
    tells = reduce(lambda x, y: x | y, tells, F.col("token").startswith("#"))
    best = counts.where((F.col("token") != _DOC) & tells).orderBy(F.desc(gain), "token").limit(VOCABULARY)
    evidence = materialize(best.select("token", *[(TEMPER * (F.log(r) - F.log(1 - r))).alias(f"w_{i}") for i, r in enumerate(rate)],
                                       *[(TEMPER * F.log(1 - r)).alias(f"a_{i}") for i, r in enumerate(rate)]), "mix-words")
    absent = evidence.agg(*[F.sum(f"a_{i}").alias(f"a_{i}") for i in range(len(size))]).first()
    prior = [float(np.log((s + SMOOTHING) / (total + SMOOTHING * len(size)))) + (absent[f"a_{i}"] or 0.0) for i, s in enumerate(size)]
    first = docs.sparkSession.range(1).select(F.lit(_DOC).alias("token"), *[F.lit(x).alias(f"w_{i}") for i, x in enumerate(prior)])
    return evidence.drop(*[f"a_{i}" for i in range(len(size))]).unionAll(first)


def posteriors(rows: DataFrame, words: DataFrame, n_domains: int) -> DataFrame:
    """rows(id, .., tokens) -> the columns but tokens, and p_0 ..; id is unique.
    ``words`` has at most ``VOCABULARY + 1`` rows, so it is sent to every task."""
    # explode_outer: for explode, a filter on the tokens is put below and computes them once more
    keep = [c for c in rows.columns if c != "tokens"]
    long = rows.select(*keep, F.explode_outer("tokens").alias("token"))
    k = range(n_domains)
    z = (long.join(F.broadcast(words), "token").groupBy(*keep)
         .agg(*[F.sum(f"w_{i}").alias(f"z_{i}") for i in k]))
    top = reduce(lambda x, y: F.when(x >= y, x).otherwise(y), [F.col(f"z_{i}") for i in k])
    z = z.withColumn("top", top).withColumns({f"e_{i}": F.exp(F.col(f"z_{i}") - F.col("top")) for i in k})
    return z.select(*keep, *[(F.col(f"e_{i}") / sum(F.col(f"e_{j}") for j in k)).alias(f"p_{i}") for i in k])


def rate_column(steps: list[list[float]], start: Column | None = None) -> Column:
    """Rate of a document after the steps: each takes off the posterior-weighted
    step and projects to zero or more; they begin with ``start`` (else 1). As the steps are a few
    numbers each, a document's rate is computed from them afresh and no rates
    are stored between steps."""
    rate = F.lit(1.0) if start is None else start
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - sum(F.col(f"p_{i}") * F.lit(float(x)) for i, x in enumerate(step)))
    return rate


class Fit(NamedTuple):
    steps: list[list[float]]  # for ``rate_column``
    gap: float  # largest difference of a domain's tokens from its target, over all target tokens
    converged: bool  # targets met, or as near as nonnegative rates come


def fit_rates(members: DataFrame, weights: list[float]) -> Fit:
    """Projected gradient steps for members(n_tokens, p_0 ..).

    With T the expected domain tokens at the present rates and t the targets, the
    objective is (T - t)' W (T - t) / 2, where W is the inverse of the sum of
    n p p' over the documents: it whitens the domains, so that in the metric of the
    token counts the gradient's Lipschitz constant is 1 and a step of size 1 always
    descends. First a longer step is tried, whitened by the documents whose rate
    is still above zero; it is taken if it descends enough. t is ``weights`` times the
    total at which the first domain keeps its tokens. The fit ends when the targets
    are met, or when a step of size 1 moves next to no tokens, which is the
    condition of the optimum with nonnegative rates: then targets out of reach are
    met as nearly as the objective allows. If neither holds after ``MAX_STEPS``
    steps, or ``STALLS`` of them in a row gain next to nothing, the fit is returned as
    not converged; a gap over ``OFF`` gives a warning."""
    k = len(weights)
    n = F.col("n_tokens").cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def sums(steps):
        rates = members.withColumn("r0", rate_column(steps[:-1]))
        got = rates.withColumn("r", rate_column(steps[-1:], F.col("r0"))).agg(
            F.sum(n * F.abs(F.col("r") - F.col("r0"))).alias("moved"), F.sum(n * F.col("r0")).alias("of"),
            *[F.sum(n * F.col("r") * F.col(f"p_{i}")).alias(f"t_{i}") for i in range(k)],
            *[F.sum(F.when(F.col("r") > 0, n * F.col(f"p_{i}") * F.col(f"p_{j}"))).alias(f"m_{i}_{j}") for i, j in pairs]).first()
        m = np.array([[got[f"m_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        return np.array([got[f"t_{i}"] or 0.0 for i in range(k)]), m, (got["moved"] or 0.0) <= STILL * (got["of"] or 0.0)

    inverse = lambda m: np.linalg.pinv(m + RIDGE * max(1.0, m.trace()) * np.eye(k))
    share = np.array(weights, float) / sum(weights)
    steps: list[list[float]] = []
    now, active, _ = sums(steps)
    target = share * now[0] / share[0]
    whiten = inverse(active)
    loss = lambda t: float((t - target) @ whiten @ (t - target))
    gap = lambda t: float(np.abs(t - target).max() / max(1.0, target.sum()))
    done, stalled = gap(now) <= TOLERANCE, 0
    while not done and len(steps) < MAX_STEPS:
        before = loss(now)
        for w in (inverse(active), whiten):
            trial = [*steps, (w @ (now - target)).tolist()]
            then, left, still = sums(trial)
            gains = loss(then) < before * (1 - 1e-4)
            if gains:
                break
        done = gap(then) <= TOLERANCE or (w is whiten and still)
        steps, now, active = trial, then, left
        stalled = 0 if gains else stalled + 1
        if stalled == STALLS:
            break
    if gap(now) > OFF:
        state = "out of reach" if done else f"not reached in {len(steps)} steps"
        warnings.warn(f"mixing targets {state}: {gap(now):.2%} of the target tokens off", stacklevel=2)
    return Fit(steps, gap(now), done)


def _fitted(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    domains = list(targets)
    if not domains or min(targets.values()) < 0 or targets[domains[0]] <= 0:
        raise ValueError("targets need weights of zero or more, above zero for the first domain")
    words = learn_words(docs, labelled, domains)
    among = [r.token for r in words.select("token").collect()]  # VOCABULARY + 1 at most
    rows = _rows(docs, *[c for c in docs.columns if c != "text"], among=among)
    members = materialize(posteriors(rows, words, len(domains)), "mix-members")
    fit = fit_rates(members, list(targets.values()))
    # part of a copy becomes a whole one for that part of the ids, by a hash
    chance = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(11)), 11) / F.lit(float(1 << 53))
    return (members.withColumn("rate", rate_column(fit.steps)).withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))
            .withColumn("target_gap", F.lit(fit.gap)).withColumn("converged", F.lit(fit.converged)))


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """documents -> doc_id, n_tokens, p_<domain> .., rate, copies, target_gap,
    converged; one row per input row. The last two are of the whole fit (see
    ``Fit``): how far the expected tokens stay from the targets, and whether no
    rates come nearer. ``targets`` are the wanted shares of all tokens by domain; the
    first domain keeps its expected tokens and the others are scaled to it.

    Null and empty texts have no tokens, a posterior from the marks alone, and no
    weight in the fit. Labels with a null id or of another domain are left out, of
    repeated labels the least domain counts. Without labels all posteriors are
    equal. Repeated rows count each time; an empty table gives an empty table."""
    got = _fitted(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("id")), labelled, targets)
    return got.select("doc_id", "n_tokens", *[F.col(f"p_{i}").alias(f"p_{d}") for i, d in enumerate(targets)], "rate", "copies",
                      "target_gap", "converged")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """The rows of ``docs`` repeated ``copies`` times (0: left out), columns
    unchanged, so that the expected domain tokens meet the targets; where they
    cannot, or the fit did not converge, a warning says how far off they are.
    Null and empty texts, labels and empty tables as in ``mixing_rates``; rows
    equal in id and text are repeated alike. Columns of ``docs`` keep any name."""
    flat = docs.select("doc_id", "text", *row_key(), F.monotonically_increasing_id().alias("id"))
    got = _fitted(flat, labelled, targets).where("copies > 0")
    copies = materialize(got.select("row_id", "row_hash", "copies").distinct(), "mix-copies")
    rows = docs.select(packed(docs).alias("row"), *row_key()).join(copies, ["row_id", "row_hash"])
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("n")).select("row.*")
