"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into segments. If two fingerprints differ by at most
``max_bits`` bits, they differ by at most ``radius[s]`` bits in some segment s,
where the radii plus one sum up to ``max_bits + 1``. Each fingerprint is stored
once per segment; a lookup enumerates the Hamming ball of that radius round its
own segment value, fetches the matches and verifies the whole distance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..session import materialize
from .common import packed, row_key, task_count
from .components import connected_components

SHINGLE_WORDS = 4
MAX_BITS = 4
SEGMENTS = 3
SEED = 42
TASK_PRINTS, LEAST_TASK_PRINTS = 1_000_000, 10_000  # fingerprints whose balls one task enumerates
_CHUNK = 1 << 16  # shingles whose bits are counted at once: bounds memory for very long texts


def fingerprint(raw: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text (null or without words: 0)."""
    words = (raw or b"").lower().split()  # bytes: A-Z only, and exactly \x20 \x09-\x0d
    n = len(words)
    if not n:
        return 0
    text = b" ".join(words)
    if n <= shingle:
        starts, ends = np.zeros(1, np.int64), np.array([len(text)])
    else:
        step = np.fromiter(map(len, words), np.int64, n) + 1
        begin = np.cumsum(step) - step
        starts, ends = begin[: n - shingle + 1], (begin + step - 1)[shingle - 1:]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        spans = zip(starts[at:at + _CHUNK].tolist(), ends[at:at + _CHUNK].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in spans], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprint_column(text: Column, shingle: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a (signed) bigint column."""
    @arrow_udf("bigint")
    def prints(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.binary()).to_pylist()
        return pa.array(np.fromiter((fingerprint(x, shingle) for x in raw), np.uint64, len(raw)).view(np.int64))
    return prints(text.cast("string"))


def segment_plan(max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> list[tuple[int, int, int]]:
    """(offset, width, radius) of each segment. The wider segments get the
    smaller radius; a radius of -1 means that the segment needs no lookup."""
    if not 2 <= segments <= 16:
        raise ValueError("2 to 16 segments")
    widths = sorted(64 // segments + (s < 64 % segments) for s in range(segments))
    base, more = divmod(max_bits + 1, segments)
    plan, offset = [], 0
    for s, width in enumerate(widths):
        plan.append((offset, width, base - 1 + (s < more)))
        offset += width
    return plan


def _key(fp: Column, s: int, offset: int, width: int) -> Column:
    value = F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << width) - 1))
    return value.bitwiseOR(F.lit(s << 40))


def links(nodes: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``nodes(fp)`` that connect
    exactly the fingerprints within ``max_bits`` bits.

    First every bucket's members are compared with its least fingerprint: those
    near it are linked to it and carry it as ``rep``. The lookup then leaves out
    pairs with the same rep, as they are connected already, so a dense group of
    near copies gives about one link a member and not all its pairs.
    """
    plan = segment_plan(max_bits, segments)
    fp = F.col("fp")
    stored = nodes.select("fp", F.explode(F.array(*[
        _key(fp, s, offset, width) for s, (offset, width, radius) in enumerate(plan) if radius >= 0])).alias("key"))
    first = materialize(stored.groupBy("key").agg(F.min("fp").alias("first"), F.count(F.lit(1)).alias("n"))
                        .where("n > 1").drop("n"), "simhash-first")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("first"))) <= max_bits
    rep = stored.join(first, "key").where(near).groupBy("fp").agg(F.min("first").alias("rep"))
    known = materialize(nodes.join(rep, "fp", "left").select("fp", F.coalesce("rep", "fp").alias("rep")), "simhash-rep")
    balls = []
    for s, (offset, width, radius) in enumerate(plan):
        flips = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]
        if flips:
            home = _key(fp, s, offset, width)
            balls.append(F.array(*[home.bitwiseXOR(F.lit(x).cast("bigint")) for x in flips]))
    # a ball has some 45 keys: the rows to look up are spread by their number, not by the small table's bytes
    tasks = task_count(nodes.sparkSession, known.count(), TASK_PRINTS, LEAST_TASK_PRINTS)
    lookups = known.repartition(tasks, "fp").select("fp", "rep", F.explode(F.concat(*balls)).alias("key"))
    buckets = known.select(F.col("fp").alias("fp2"), F.col("rep").alias("rep2"), F.explode(F.array(*[
        _key(fp, s, offset, width) for s, (offset, width, radius) in enumerate(plan) if radius >= 0])).alias("key2"))
    found = lookups.join(buckets, (F.col("key") == F.col("key2")) & (F.col("fp") < F.col("fp2"))
                         & (F.col("rep") != F.col("rep2"))
                         & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_bits))
    return (known.where("rep <> fp").select(F.col("fp").alias("u"), F.col("rep").alias("v"))
            .unionAll(found.select(F.col("fp").alias("u"), F.col("fp2").alias("v"))))


def _classes(prints: DataFrame, chosen: Column, max_bits: int, segments: int) -> DataFrame:
    """(fp, chosen): for every fingerprint the least ``chosen`` of its component."""
    nodes = materialize(prints.groupBy("fp").agg(F.min(chosen).alias("chosen")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp"), max_bits, segments))
    member = materialize(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                         .select("fp", "chosen", F.coalesce("root", "fp").alias("root")), "simhash-member")
    best = materialize(member.groupBy("root").agg(F.min("chosen").alias("chosen")), "simhash-best")
    return member.drop("chosen").join(best, "root").select("fp", "chosen")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                       segments: int = SEGMENTS) -> DataFrame:
    """documents -> (doc_id, fingerprint, component_id), one row per input row.

    Null and empty texts have the fingerprint zero and are linked like any
    other. Repeated rows give repeated result rows. Null ids are kept; they
    never name a component unless it holds nothing else (then null). An empty
    table gives an empty table; other columns are not looked at.
    """
    prints = materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                                     fingerprint_column(F.col("text"), shingle).alias("fp")), "simhash-prints")
    named = materialize(_classes(prints, F.col("doc_id"), max_bits, segments), "simhash-named")
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("chosen").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                         segments: int = SEGMENTS) -> DataFrame:
    """Keep one row of each component: the least doc_id (null ids last), of
    repeated ids one row. Columns are those of ``docs``, whatever their names."""
    prints = materialize(docs.select("doc_id", *row_key(), fingerprint_column(F.col("text"), shingle).alias("fp")), "simhash-prints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row_id"), F.col("row_hash"))
    best = _classes(prints, order, max_bits, segments).select("chosen.row_id", "chosen.row_hash").distinct()
    kept = materialize(best, "simhash-kept")
    rows = docs.select(packed(docs).alias("row"), *row_key())
    return rows.join(kept, ["row_id", "row_hash"], "left_semi").dropDuplicates(["row_id", "row_hash"]).select("row.*")
