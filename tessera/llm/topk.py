"""Exact top-k inner-product search over quantised vectors.

Vectors are packed into blocks. Every block of queries meets every shard of
candidates as one matrix product, each tile gives its queries' best ``k``, and
the lists of a query are merged by a tree of bounded fan-in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

TOP = 20
SCALE = 64
QUERY_EVERY = 20
SHARD_ROWS = 4096
BLOCK_ROWS = 1024
FAN_IN = 16
SHARDS_PER_GROUP = 4  # shards that share one copy of a query block in the shuffle
_BLOCK = "block bigint, dim int, ids binary, data binary"
_PART = "query bigint, query_id bigint, shard bigint, vec_id array<bigint>, score array<bigint>"
_LONG = (1 - (1 << 63), (1 << 63) - 1)


def quantise(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles; python ints where int64 is too small."""
    x = np.floor(scale * values.astype(np.float64))
    if not x.size or np.abs(x).max() < 2.0 ** 62:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def _pack(rows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (TaskContext.get().partitionId()) << 32
        seq, held = 0, {}

        def flush(dim):
            nonlocal seq
            ids, vectors = held.pop(dim)
            seq += 1
            return pa.RecordBatch.from_arrays([
                pa.array([first + seq - 1]), pa.array([dim], pa.int32()),
                pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()),
                pa.array([np.concatenate(vectors).astype("<f8").tobytes()], pa.binary())],
                names=["block", "dim", "ids", "data"])

        for batch in batches:
            vecs = batch.column(1)
            sizes = np.diff(vecs.offsets.to_numpy())
            flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ids = batch.column(0).to_numpy()
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                for at in range(0, len(own), rows):
                    some = own[at:at + rows]
                    ids_of, data_of = held.setdefault(dim, ([], []))
                    ids_of.append(ids[some])
                    data_of.append(flat[starts[some][:, None] + np.arange(dim)])
                    if sum(map(len, ids_of)) >= rows:
                        yield flush(dim)
        for dim in list(held):
            yield flush(dim)
    return pack


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) as bigint and array of double, without null ids, null
    vectors, and vectors that hold a null or a non-finite component."""
    vec = F.col("embedding").cast("array<double>")
    return (vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), vec.alias("embedding"))
            .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
            .where(F.forall(F.col("embedding"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))))


def tile_top(q_ids, q, c_ids, c, k: int) -> Iterator[tuple[list[int], list[int]]]:
    """For each query row the ids and scores of its ``k`` best candidates with
    another id: highest score first, ties to the smaller id. ``c_ids`` ascend."""
    n = len(c_ids)
    exact = q.dtype != object and c.dtype != object
    if exact:
        bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
        exact = bound * 2 * max(n, 1) < 2.0 ** 52
    if exact:
        scores = (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
        order = scores * n + np.arange(n - 1, -1, -1)  # one key: score, then the smaller id
        own = q_ids[:, None] == c_ids[None, :]
        order[own] = np.iinfo(np.int64).min
        take = min(n, k)
        top = np.argpartition(order, n - take, axis=1)[:, n - take:] if take < n else np.tile(np.arange(n), (len(q), 1))
        for i, places in enumerate(top):
            places = places[np.argsort(-order[i, places], kind="stable")]
            places = places[~own[i, places]]
            yield c_ids[places].tolist(), scores[i, places].tolist()
        return
    rows = [[int(x) for x in r] for r in c]
    for i, r in enumerate(q):
        r = [int(x) for x in r]
        got = sorted((-sum(a * b for a, b in zip(r, x)), int(v)) for v, x in zip(c_ids, rows) if v != q_ids[i])[:k]
        yield [v for _, v in got], [min(_LONG[1], max(_LONG[0], -s)) for s, _ in got]


def _tiles(k: int, scale: int):
    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                dim = x["dim"]
                q_ids, c_ids = (np.frombuffer(x[s], "<i8") for s in ("q_ids", "c_ids"))
                q, c = (quantise(np.frombuffer(x[s], "<f8").reshape(len(ids), dim), scale) for s, ids in (("q_data", q_ids), ("c_data", c_ids)))
                order = np.argsort(c_ids, kind="stable")
                got = list(tile_top(q_ids, q, c_ids[order], c[order], k))
                yield pa.RecordBatch.from_arrays([
                    pa.array((x["q_block"] << 20) + np.arange(len(q_ids))), pa.array(q_ids),
                    pa.array(np.full(len(q_ids), x["c_block"])),
                    pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.int64()))],
                    names=["query", "query_id", "shard", "vec_id", "score"])
    return tiles


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = TOP, scale: int = SCALE,
                shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vectors(vec_id, embedding) -> (query_id, rank, vec_id, score): the ``k``
    best candidates of every row with ``is_query``, against all rows of the same
    length with another id; all of them if fewer.

    Components become floor(scale * x); the score is their exact integer inner
    product (beyond 64 bits it is computed exactly and shown at the limit).
    Ties go to the smaller vec_id. Rows with a null id, a null vector, or a null
    or non-finite component take no part. A repeated query row gives its list
    again, a repeated candidate counts each time. Empty tables give no rows.
    """
    rows = _usable(vectors)
    shards = materialize(rows.mapInArrow(_pack(shard_rows), _BLOCK), "topk-shards")
    blocks = materialize(rows.where(is_query).mapInArrow(_pack(block_rows), _BLOCK), "topk-blocks")
    # every block of the stated query set goes to every group of shards
    n_shards = shards.count()
    groups = max(1, -(-n_shards // SHARDS_PER_GROUP))
    left = blocks.select(F.col("block").alias("q_block"), "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"),
                         F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
    right = shards.select(F.col("block").alias("c_block"), "dim", F.col("ids").alias("c_ids"), F.col("data").alias("c_data"),
                          F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("grp"))
    parts = materialize(left.join(right, ["grp", "dim"]).mapInArrow(_tiles(k, scale), _PART), "topk-parts")
    # ascending (-score, id) is the order of the result
    lists = parts.select("query", "query_id", F.pmod(F.xxhash64("shard"), F.lit(max(1, n_shards))).alias("at"), F.zip_with(
        "score", "vec_id", lambda s, v: F.struct(F.negative(s).alias("s"), v.alias("v"))).alias("top"))
    width = n_shards
    while True:
        width = max(1, -(-width // FAN_IN))
        lists = (lists.groupBy("query", "query_id", F.pmod(F.col("at"), F.lit(width)).alias("at"))
                 .agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")))
        if width == 1:
            break
    best = lists.select("query_id", F.posexplode("top").alias("at", "x"))
    return best.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.v").alias("vec_id"),
                       F.negative(F.col("x.s")).alias("score"))
