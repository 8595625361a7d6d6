"""Whitening of quantised vectors by principal components.

Sums and the centred covariance are added up by tasks over Arrow batches; only
numbers per dimension and one d x d matrix reach the driver, never vectors. There
the matrix is brought to tridiagonal form by Householder reflections, the leading
eigenvalues are bisected with Sturm counts, their vectors found by inverse
iteration with reorthogonalisation inside clusters, and the components are
broadcast to project every vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

COMPONENTS = 32
SCALE = 64
OFFSET = 1_000_000
MAX_DIMS = 4096  # a d x d matrix of doubles is held by each task and the driver: 128 MB here
MIN_SHARE = 1e-10  # of the largest eigenvalue: below it a direction is rounding, not variance
CLUSTER_GAP = 1e-3  # eigenvalues closer than this share of the norm are one cluster
_LIMIT = 1 << 62  # quantised entries stop here, far beyond any embedding
_LONG = (1 << 63) - 1


# -- numbers of a task ---------------------------------------------------------

def quantise(values: np.ndarray, scale: int = SCALE, offset: int = OFFSET) -> np.ndarray:
    """floor(scale * c) + offset as int64, held between -2^62 and 2^62."""
    x = np.clip(np.floor(scale * values.astype(np.float64)), -float(_LIMIT), float(_LIMIT)).astype(np.int64)
    return np.clip(x + offset, -_LIMIT, _LIMIT)


def spread_from_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: int64 where that holds it, else Python integers."""
    if x.size and n * int(np.abs(x).max()) + max(map(abs, sums)) >= _LIMIT:
        return x.astype(object) * n - np.array(sums, object)
    return x * np.int64(n) - np.array(sums, np.int64)


def centred(z: np.ndarray, n: int) -> np.ndarray:
    """x - S / n as doubles, from n * x - S, so the offset costs no digits."""
    if z.dtype == object:
        return np.array([int(v) / n for v in z.ravel()], np.float64).reshape(z.shape)
    return z.astype(np.float64) / n


def deviations(z: np.ndarray) -> list[int]:
    """Exact sum of squares of each row, shown at the largest long beyond that."""
    if z.dtype == object:
        return [min(_LONG, sum(int(v) ** 2 for v in row)) for row in z]
    about = (z.astype(np.float64) ** 2).sum(axis=1)
    out = np.where(about < 2.0 ** 62, (z * z).sum(axis=1), _LONG)  # a wrapped sum is replaced
    for i in np.flatnonzero((about >= 2.0 ** 62) & (about < 2.0 ** 63 * 1.001)):
        out[i] = min(_LONG, sum(int(v) ** 2 for v in z[i]))
    return out.tolist()


def _blocks(batches: Iterator[pa.RecordBatch], width: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, matrix of one width) of the batches of (vec_id, vec)."""
    for batch in batches:
        vecs = batch.column(1)
        sizes = np.diff(vecs.offsets.to_numpy())
        flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.cumsum(sizes) - sizes
        for dim in np.unique(sizes).tolist() if width is None else [width]:
            own = np.flatnonzero(sizes == dim)
            if len(own):
                yield batch.column(0).take(pa.array(own)), flat[starts[own][:, None] + np.arange(dim)]


def _sums(scale: int, offset: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[int]]] = {}
        for _, m in _blocks(batches):
            x = quantise(m, scale, offset)
            # two halves keep the sums inside 64 bits; Python integers put them together
            part = [(int(a) << 31) + int(b) for a, b in zip((x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0))]
            n, sums = found.get(m.shape[1], (0, [0] * m.shape[1]))
            found[m.shape[1]] = (n + len(m), [a + b for a, b in zip(sums, part)])
        for dim, (n, sums) in found.items():
            rows = [(dim, -1, Decimal(n)), *((dim, j, Decimal(s)) for j, s in enumerate(sums))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                              pa.array([r[2] for r in rows], pa.decimal128(38, 0))], names=["width", "dim", "total"])
    return run


def _products(of, width: int):
    """Task sums of outer products: one row of the matrix per output row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for y in of(batches):
            p = y.T @ y
            total = p if total is None else total + p
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))],
                                             names=["dim", "line"])
    return run


def _summed_matrix(vectors: DataFrame, of, width: int) -> np.ndarray:
    """The width x width sum over all tasks, added up by Spark line by line."""
    lines = vectors.mapInArrow(_products(of, width), "dim int, line array<double>")
    total = lines.groupBy("dim").agg(vector_to_array(Summarizer.sum(array_to_vector("line"))).alias("line"))
    out = np.zeros((width, width))
    for r in total.collect():  # width rows of width numbers
        out[r["dim"]] = r["line"]
    return (out + out.T) / 2


# -- eigenvectors of a symmetric matrix ------------------------------------------

def tridiagonalise(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder: the diagonal, the subdiagonal and the unit reflectors of a."""
    a = a.astype(np.float64).copy()
    n, mirrors = len(a), []
    for k in range(n - 2):
        x = a[k + 1:, k]
        size = np.linalg.norm(x)
        v = np.zeros(n - k - 1)
        if size > 0 and np.any(x[1:]):
            v = x.copy()
            v[0] += np.copysign(size, x[0])
            v /= np.linalg.norm(v)
            b = a[k + 1:, k + 1:]
            p = b @ v
            w = p - (v @ p) * v
            b -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1:, k] = x - 2 * (v @ x) * v
            a[k, k + 1:] = a[k + 1:, k]
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def _norm(d: np.ndarray, e: np.ndarray) -> float:
    return float(np.max(np.abs(d) + np.r_[np.abs(e), 0.0] + np.r_[0.0, np.abs(e)]))


def count_below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm counts: eigenvalues below each x, the negative pivots of T - x."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    q = d[0] - x
    n = (q < 0).astype(np.int64)
    for i in range(1, len(d)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d[i] - x - e[i - 1] * e[i - 1] / q
        n += q < 0
    return n


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, all bisected together."""
    n, norm = len(d), _norm(d, e)
    rank = n - 1 - np.arange(k)  # eigenvalues below the wanted one
    low, high = np.full(k, -norm * 1.001), np.full(k, norm * 1.001)
    while norm:
        mid = (low + high) / 2
        if not np.any((mid > low) & (mid < high)) or np.max(high - low) <= norm * 2.0 ** -53:
            break
        under = count_below(d, e, mid) <= rank
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def _solve(d: np.ndarray, e: np.ndarray, at: np.ndarray, b: np.ndarray, small: float) -> np.ndarray:
    """(T - at_j) x_j = b_j for all j: tridiagonal elimination with row exchanges."""
    n, k = len(d), len(at)
    main, up, far = np.empty((n, k)), np.zeros((n, k)), np.zeros((n, k))
    x = b.copy()
    row, nxt = d[0] - at, np.full(k, e[0] if n > 1 else 0.0)
    for i in range(n - 1):
        under, mid, right = np.full(k, e[i]), d[i + 1] - at, np.full(k, e[i + 1] if i + 2 < n else 0.0)
        swap = np.abs(under) > np.abs(row)
        top = np.where(swap, under, row)
        top = np.where(np.abs(top) < small, np.copysign(small, top), top)
        ratio = np.where(swap, row, under) / top
        main[i], up[i], far[i] = top, np.where(swap, mid, nxt), np.where(swap, right, 0.0)
        first, second = np.where(swap, x[i + 1], x[i]), np.where(swap, x[i], x[i + 1])
        row = np.where(swap, nxt, mid) - ratio * up[i]
        nxt = np.where(swap, 0.0, right) - ratio * far[i]
        x[i], x[i + 1] = first, second - ratio * first
    main[n - 1] = np.where(np.abs(row) < small, np.copysign(small, row), row)
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            x[i] -= up[i] * x[i + 1]
        if i + 2 < n:
            x[i] -= far[i] * x[i + 2]
        x[i] /= main[i]
    return x


def inverse_iteration(d: np.ndarray, e: np.ndarray, values: np.ndarray, steps: int = 5) -> np.ndarray:
    """Unit vectors (columns) of falling ``values``; inside a cluster each is made
    orthogonal to those before it after every step."""
    n, k, norm = len(d), len(values), _norm(d, e)
    small = max(norm * np.finfo(float).eps, np.finfo(float).tiny)
    first = np.arange(k)  # where the cluster of each value begins
    at = values.copy()
    for j in range(1, k):
        if values[j - 1] - values[j] <= CLUSTER_GAP * norm:
            first[j] = first[j - 1]
            at[j] = min(at[j], at[j - 1] - 10 * small)  # equal values get shifts of their own
    x = np.random.default_rng(1).uniform(-1, 1, (n, k))
    for _ in range(steps):
        x = _solve(d, e, at, x / np.linalg.norm(x, axis=0), small)
        x /= np.abs(x).max(axis=0)
        for j in range(k):
            for _ in range(2):
                for i in range(first[j], j):
                    x[:, j] -= (x[:, i] @ x[:, j]) * x[:, i]
            x[:, j] /= np.linalg.norm(x[:, j])
    return x


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of symmetric ``v``, falling: at
    most ``k``, and none below ``MIN_SHARE`` of the first."""
    if not len(v) or not np.any(v):
        return np.zeros(0), np.zeros((len(v), 0))
    unit = float(np.abs(v).max())
    d, e, mirrors = tridiagonalise(v / unit)
    values = leading_eigenvalues(d, e, min(k, len(v)))
    values = values[values > MIN_SHARE * max(values[0], 0.0)]
    x = inverse_iteration(d, e, values)
    for at in range(len(mirrors) - 1, -1, -1):
        m = mirrors[at]
        x[at + 1:] -= 2 * np.outer(m, m @ x[at + 1:])
    return values * unit, x / np.linalg.norm(x, axis=0)


# -- the operator ----------------------------------------------------------------

@dataclass(frozen=True)
class Whitening:
    """A fit: rows and sums of the quantised vectors, falling eigenvalues, components
    as columns, their shares of the trace, and the largest entry of the whitened
    covariance minus the identity."""
    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float
    scale: int = SCALE
    offset: int = OFFSET

    @property
    def width(self) -> int:
        return len(self.sums)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id bigint, vec array<double>) without null vectors and vectors that hold a
    null or a non-finite entry. A null id stays."""
    vec = F.col(f"`{vector_col}`").cast("array<double>")
    return (vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), vec.alias("vec")).where("vec is not null")
            .where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))))


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET,
                  id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening:
    """Fits over all usable rows of the commonest width (the larger if two are equally
    common); repeated rows count each time. No usable row gives an empty fit. Every
    covariance has divisor n and is centred before multiplying."""
    rows = usable(vectors, id_col, vector_col)
    sums = materialize(rows.mapInArrow(_sums(scale, offset), "width int, dim int, total decimal(38,0)")
                       .groupBy("width", "dim").agg(F.sum("total").alias("total")), "whitening-sums")
    best = sums.where("dim = -1").orderBy(F.desc("total"), F.desc("width")).first()
    if best is None:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0, scale, offset)
    n, width = int(best["total"]), int(best["width"])
    if width > MAX_DIMS:
        raise ValueError(f"vectors of {width} entries: a covariance matrix is held whole up to {MAX_DIMS}")
    totals = [int(r["total"]) for r in sums.where((F.col("width") == width) & (F.col("dim") >= 0)).orderBy("dim").collect()]
    if not width:
        return Whitening(n, [], np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0, scale, offset)

    def centre(batches):
        for _, m in _blocks(batches, width):
            yield centred(spread_from_mean(quantise(m, scale, offset), n, totals), n)

    cov = _summed_matrix(rows, centre, width) / n
    values, comps = leading_components(cov, components)
    trace = float(np.trace(cov))
    k = len(values)
    fit = Whitening(n, totals, values, comps, values / trace if k else values, 0.0, scale, offset)
    if not k:
        return fit
    # the whitened mean is what is left of the mean after centring, rounding only
    project = comps / np.sqrt(values)

    def whitened(batches):
        for y in centre(batches):
            yield y @ project

    def line_of_sums(batches):
        total = sum((w.sum(axis=0) for w in whitened(batches)), np.zeros(k))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["line"])

    means = rows.mapInArrow(line_of_sums, "line array<double>").agg(vector_to_array(Summarizer.sum(array_to_vector("line"))).alias("line"))
    mean = np.array(means.first()["line"]) / n

    def around_mean(batches):
        for w in whitened(batches):
            yield w - mean

    error = float(np.abs(_summed_matrix(rows, around_mean, k) / n - np.eye(k)).max())
    return Whitening(n, totals, values, comps, values / trace, error, scale, offset)


def whiten(vectors: DataFrame, fit: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of every usable row of the fit's
    width: the sum over dimensions of (n*x - S)^2, exact (beyond a long the largest
    long), and x - S/n on each component over the root of its eigenvalue.

    Entries are held at +-2^62 once quantised. Null vectors, vectors with a null or
    non-finite entry and vectors of another width give no row; a null id does. Equal
    rows give equal results each. Other columns are not read. The fit, a few numbers
    a dimension and component, is broadcast.
    """
    project = fit.components / np.sqrt(fit.values) if len(fit.values) else np.zeros((fit.width, 0))
    held = vectors.sparkSession.sparkContext.broadcast((fit.n, fit.sums, project))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, p = held.value
        for ids, m in _blocks(batches, len(sums)):
            z = spread_from_mean(quantise(m, fit.scale, fit.offset), n, sums)
            w = centred(z, n) @ p
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(deviations(z), pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    out = "vec_id bigint, deviation bigint, whitened array<double>"
    return usable(vectors, id_col, vector_col).mapInArrow(run, out)


def whitened_rows(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for
    each usable vector and component with variance, see :func:`whiten`. Vectors that
    are all equal, or an empty table, have no such component and give no rows."""
    fit = fit_whitening(vectors, components)
    long = whiten(vectors, fit).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(float(s)) for s in fit.explained]) if len(fit.explained) else F.array().cast("array<double>")
    return long.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("bigint").alias("n"), "deviation",
                       "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(fit.identity_error).alias("identity_error"))
