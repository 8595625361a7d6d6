"""Quality rules with host verdicts.

Every document is tested by fixed rules. The failures are summed by host
(``source``), the hosts' failure rates are shrunk to the overall rate with a beta
prior fitted to all hosts, and each host's verdict is joined back to its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..session import materialize
from .common import packed

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20  # of words in 5-word windows that occur twice or more
WINDOW = 5
MAX_SYMBOL_PERCENT = 10  # symbols per 100 words
MAX_DUP_LINE_PERCENT = 30  # of lines with a word
MAX_WORD_CHARS = 25  # mean word length
MAX_HOST_RATE = 0.5  # shrunk share of a host's documents that fail a rule
MAX_PRIOR = 1e6  # strength of the prior when hosts differ no more than by chance

_SYMBOLS = [c.encode() for c in "#*$%&|<>"]
_SPACES = b" \t\n\x0b\x0c\r"
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_TYPE = "struct<" + ",".join(f"{f}:bigint" for f in _FIELDS) + ">"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more.
    Exact: windows are compared by word numbers, not by hashes."""
    n = len(words)
    if n <= window:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    size, codes = len(number), ids
    for k in range(1, window):  # code of the first k + 1 words
        if len(codes) - 1 <= 0:
            return 0
        if size * len(number) >= 1 << 62:
            _, codes = np.unique(codes, return_inverse=True)
            size = int(codes.max()) + 1
        codes = codes[:-1] * len(number) + ids[k:]
        size *= len(number)
    ordered = np.sort(codes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = np.isin(codes, twice)
    covered = np.zeros(n, bool)
    for k in range(window):
        covered[k:k + len(codes)] |= again
    return int(covered.sum())


def measure(raw: bytes | None) -> tuple[int, ...]:
    """The counts of ``_FIELDS`` over one whole UTF-8 text (null: all zero)."""
    if not raw:
        return 0, 0, 0, 0, 0, 0
    words = raw.split()
    # code points in words: bytes that start a character
    chars = len(raw) - len(raw.translate(None, bytes(set(range(256)) - set(range(0x80, 0xC0)))))
    chars -= sum(raw.count(bytes([c])) for c in _SPACES)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (len(words), chars, sum(map(raw.count, _SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines))


def measures(text: Column) -> Column:
    @arrow_udf(_TYPE)
    def counted(texts: pa.Array) -> pa.Array:
        rows = [measure(x) for x in texts.cast(pa.binary()).to_pylist()]
        columns = np.array(rows, np.int64).reshape(-1, len(_FIELDS)).T
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=list(_FIELDS))
    return counted(text.cast("string"))


def base_failed(m: str) -> Column:
    c = lambda f: F.col(f"{m}.{f}")
    return (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))


def any_failed(m: str) -> Column:
    c = lambda f: F.col(f"{m}.{f}")
    return (base_failed(m) | (100 * c("n_symbols") > MAX_SYMBOL_PERCENT * c("n_words"))
            | (100 * c("n_dup_lines") > MAX_DUP_LINE_PERCENT * c("n_lines"))
            | (c("word_chars") > MAX_WORD_CHARS * c("n_words")))


def host_verdicts(failures: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(source, failed) -> (source, n_docs, n_failed, rate, rejected), one row
    per non-null source. ``rate`` is (alpha + n_failed) / (alpha + beta + n_docs)
    with alpha, beta by the method of moments over all hosts."""
    hosts = materialize(failures.where("source is not null").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("bigint")).alias("n_failed")), "hosts")
    got = hosts.agg(F.count(F.lit(1)).alias("h"), F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"),
                    F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("ff")).first()
    alpha, beta = beta_prior(got.h, got.n or 0, got.f or 0, got.ff or 0.0)
    rate = (F.lit(alpha) + F.col("n_failed")) / (F.lit(alpha + beta) + F.col("n_docs"))
    return hosts.withColumn("rate", rate).withColumn("rejected", F.col("rate") >= max_rate)


def beta_prior(hosts: int, docs: int, failed: int, sum_ff: float) -> tuple[float, float]:
    """alpha, beta from the number of hosts, their documents, failures, and the
    sum of failures squared by documents."""
    if not docs:
        return 0.5, 0.5
    mean = failed / docs
    spread = mean * (1 - mean)
    between = sum_ff / docs - mean * mean
    chance = spread * hosts / docs  # what binomial noise alone gives
    if spread <= 0 or between <= chance:
        strength = MAX_PRIOR
    else:
        strength = min(MAX_PRIOR, max(1.0, (spread - between) / (between - chance)))
    return mean * strength, (1 - mean) * strength


def quality_rules(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """documents -> doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept; one row per input row.

    A null or empty text has no words and fails. A document with a null source
    has no host, so only the rules on itself count. Repeated rows count each
    time. An empty table gives an empty table.
    """
    rows = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"),
                                   measures(F.col("text")).alias("m")), "quality-rows")
    hosts = materialize(host_verdicts(rows.select("source", any_failed("m").alias("failed")), max_rate)
                        .select("source", "rejected"), "quality-hosts")
    judged = rows.join(hosts, "source", "left").withColumn("base_failed", base_failed("m"))
    return judged.select("doc_id", *[F.col(f"m.{f}").alias(f) for f in _FIELDS[:5]], "base_failed",
                         (~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))).alias("kept"))


def keep_good(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, columns unchanged. The
    texts are read and measured twice, for the hosts and for the rows, rather
    than stored or shuffled."""
    rows = docs.select(packed(docs).alias("row"), F.col("source").cast("string").alias("source"), measures(F.col("text")).alias("m"))
    failures = docs.select(F.col("source").cast("string").alias("source"), measures(F.col("text")).alias("m"))
    hosts = host_verdicts(failures.select("source", any_failed("m").alias("failed")), max_rate)
    rejected = materialize(hosts.where("rejected").select("source"), "quality-rejected")
    return rows.where(~base_failed("m")).join(rejected, "source", "left_anti").select("row.*")
