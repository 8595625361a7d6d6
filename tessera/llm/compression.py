"""Quality by compression.

A zstandard dictionary is trained on good texts and one on bad texts. A text is
compressed with each and with none; the difference of the two sizes, over the
plain compressed size, says which kind it resembles. A logistic fit on other
labelled texts turns that difference, the plain compression ratio and the length
into a calibrated probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..session import materialize
from .common import fold, one_label_per_id, spread_by_hash

SAMPLE_TEXTS = 2500  # most texts of a class for its dictionary, and for the calibration
PIECE_BYTES = 2000  # dictionary samples
PIECES = 6000  # most samples for a dictionary, from anywhere in the texts
DICT_BYTES = 512 << 10
BLOCK_BYTES = 8 << 10  # compressed at a time
LEVEL = 3
THRESHOLD = 0.7
FOLDS, HELD_FOLD = 4, 2


def dictionary(pieces: list[bytes], size: int = DICT_BYTES) -> bytes:
    """Content of a zstandard dictionary trained on the pieces; the plain bytes where
    they are too few to train on."""
    total = sum(map(len, pieces))
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 4)), pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[:size]


class Sizes:
    """The compressor of both dictionaries; built once in each task."""

    def __init__(self, good: bytes, bad: bytes):
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self.good, self.bad = self._with(good), self._with(bad)

    def _with(self, content: bytes):
        if not content:
            return self.plain
        d = zstandard.ZstdCompressionDict(content)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def features(self, raw: bytes | None) -> tuple[float, float, float]:
        """Size difference over plain size, plain ratio, log length. A text is compressed
        in blocks, so that its later parts meet the dictionaries, too, and not only the
        text before them."""
        raw = raw or b""
        plain = difference = 0
        for at in range(0, max(1, len(raw)), BLOCK_BYTES):
            part = raw[at:at + BLOCK_BYTES]
            plain += len(self.plain.compress(part))
            difference += len(self.bad.compress(part)) - len(self.good.compress(part))
        return difference / plain, plain / (len(raw) + 1), float(np.log1p(len(raw)))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic fit by damped Newton steps."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1]), 0.0 if not len(y) else (3.0 if y[0] else -3.0)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (z @ w)).sum() + ridge / 2 * w @ w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        scale = 1.0
        while scale > 1e-4 and loss(w + scale * step) > loss(w):
            scale /= 2
        w = w + scale * step
    return w[:-1] / spread, float(w[-1] - (w[:-1] * mean / spread).sum())


def _sampled_pieces(texts: DataFrame) -> dict[int, list[bytes]]:
    """texts(y, doc_id, h, text) -> for each y at most ``PIECES`` stretches of
    ``PIECE_BYTES``, the first by a hash of text and place: of a long text as many as
    of as much short text. Places are chosen before any text is cut."""
    @arrow_udf("array<binary>")
    def cut(whole: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for t, at in zip(whole.to_pylist(), places.to_pylist()):
            raw = t.encode()
            out.append([raw[p * PIECE_BYTES:(p + 1) * PIECE_BYTES] for p in at])
        return pa.array(out, pa.list_(pa.binary()))

    last = F.floor((F.octet_length("text") - 1) / PIECE_BYTES).cast("int")
    places = texts.where("text <> ''").select("y", "doc_id", "h", F.explode(F.sequence(F.lit(0), last)).alias("at")).distinct()
    got: dict[int, list[bytes]] = {}
    for y in (0, 1):
        some = places.where(F.col("y") == y).orderBy(F.xxhash64("h", "at"), "doc_id", "at").limit(PIECES)
        lists = some.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list("at")).alias("at"))
        found = texts.where(F.col("y") == y).dropDuplicates(["doc_id", "h"]).join(lists, ["doc_id", "h"])
        rows = found.select("doc_id", "h", cut("text", "at").alias("cut")).collect()
        got[y] = [bytes(x) for r in sorted(rows, key=lambda r: (r.doc_id, r.h)) for x in r.cut]
    return got


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD_FOLD):
    """(good dictionary, bad dictionary, weights, bias) from rows of
    ``labels(doc_id, quality)`` outside the held-out fold. One of the remaining
    folds calibrates, the others build the dictionaries. All samples are the
    first rows by a hash of the id, ``SAMPLE_TEXTS`` at most of each kind, of
    any length. Only ``PIECES`` pieces of each kind and three numbers of each
    calibrating text reach the driver."""
    calibrate = (held + 1) % folds
    known = one_label_per_id(labels, "quality", F.min).where(~fold(F.col("doc_id"), folds, held))
    known = known.withColumn("part", fold(F.col("doc_id"), folds, calibrate))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    chosen = None
    for part, label in [(part, label) for part in (False, True) for label in (0, 1)]:
        some = (known.where((F.col("part") == part) & ((F.col("label") > 0) == bool(label)))
                .orderBy(spread_by_hash(3), "doc_id").limit(SAMPLE_TEXTS)
                .select("doc_id", F.lit(part).alias("part"), F.lit(label).alias("y")))
        chosen = some if chosen is None else chosen.unionAll(some)
    chosen = materialize(chosen, "quality-sample")
    rows = texts.join(chosen, "doc_id").withColumn("h", F.xxhash64("text"))
    share = known.agg(F.avg((F.col("label") > 0).cast("double")).alias("p")).first().p
    pieces = _sampled_pieces(rows.where("not part"))
    good, bad = (dictionary(pieces[y]) if pieces[y] else b"" for y in (1, 0))

    @arrow_udf("array<double>")
    def features(whole: pa.Array) -> pa.Array:
        sizes = _sizes(good, bad)
        return pa.array([sizes.features(r) for r in whole.cast(pa.binary()).to_pylist()], pa.list_(pa.float64()))

    measured = rows.where("part").select("y", "doc_id", "h", features("text").alias("x")).dropDuplicates(["y", "doc_id", "h"])
    found = measured.orderBy(spread_by_hash(3), "doc_id", "h").limit(8 * SAMPLE_TEXTS).collect()
    x = np.array([r.x for r in found]).reshape(-1, 3)
    y = np.array([float(r.y) for r in found])
    weights, bias = fit_logistic(x, y)
    if share and 0 < share < 1 and len(y) and 0 < y.mean() < 1:  # the sample is balanced, the corpus is not
        bias += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return good, bad, weights, float(bias)


def score_column(text: Column, good: bytes, bad: bytes, weights: np.ndarray, bias: float) -> Column:
    """Probability that a whole text is good (null like empty)."""
    @arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        sizes = _sizes(good, bad)
        x = np.array([sizes.features(r) for r in texts.cast(pa.binary()).to_pylist()]).reshape(-1, 3)
        return pa.array(1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30))))
    return scores(text.cast("string"))


_BUILT: dict = {}


def _sizes(good: bytes, bad: bytes) -> Sizes:
    """The compressors of the last dictionaries in this Python process."""
    key = (hash(good), hash(bad))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Sizes(good, bad)
    return _BUILT[key]


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD_FOLD,
                   threshold: float = THRESHOLD) -> DataFrame:
    """documents -> (doc_id, held_out, score, predicted), one row per input row.

    Only labels outside the held-out fold are learned from; language, source and
    id never enter a score. A null text scores like an empty one. Repeated rows
    are scored each time; of repeated labels the least counts. Without labels
    every score is 0.5, with one class only nearly 0 or 1; an empty table gives
    an empty table.
    """
    model = fit(docs, labels, folds, held)
    return (docs.select("doc_id", fold(F.col("doc_id"), folds, held).alias("held_out"),
                        score_column(F.col("text"), *model).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
