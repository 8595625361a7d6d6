"""Vocabulary, word-vector lookup and mean document vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from .indexing import dense_index

BLOCK_DOCS = 1 << 15  # documents whose sums one task holds
LEAST_BLOCKS = 16     # so that a small corpus is spread, too
OUT_ROWS = 4096       # vectors of a block handed on at a time
BLOCK_TEXT = 1 << 27  # bytes of text that one task reads beside the vectors of their words
TEXTS_AT_ONCE, TOKENS_AT_ONCE = 1024, 1 << 14  # looked up, and added up, together
_DOC, _VECTOR, _TF, _TEXT = 0, 1, 2, 3  # kinds of rows that meet in a block


def document_blocks(docs: DataFrame) -> int:
    """Number of blocks the documents are dealt into, in proportion to their number."""
    return max(LEAST_BLOCKS, math.ceil(docs.count() / BLOCK_DOCS))


def block_of(id_col: str, blocks: int) -> Column:
    return F.pmod(F.hash(F.col(id_col)), F.lit(blocks))


def by_document(docs: DataFrame, id_col: str = "doc_id", blocks: int | None = None) -> DataFrame:
    """Texts dealt by id before they are cut into tokens, so that counting a document's
    words moves no token: a text is a fraction of its tokens. Four parts a block keep
    the counts of a part in memory; the rows of a part belong to one block."""
    return docs.repartition(4 * (blocks or document_blocks(docs)), id_col)


def build_vocabulary(tokens: DataFrame, min_count: int = P.W2V_MIN_COUNT,
                     max_size: int | None = None, word_col: str = "word") -> DataFrame:
    """``(word, count, idx)``: words seen at least ``min_count`` times,
    indexed from 0 by (count desc, word). ``max_size`` keeps the top ranks.

    Counting is a partial + final hash aggregate, so a very frequent word is
    combined map-side before the shuffle and never lands as one hot group.
    """
    counts = tokens.groupBy(word_col).agg(F.count(F.lit(1)).alias("count"))
    return vocabulary_from_counts(counts, min_count, max_size, word_col)


def vocabulary_from_counts(counts: DataFrame, min_count: int = P.W2V_MIN_COUNT,
                           max_size: int | None = None, word_col: str = "word",
                           count_col: str = "count") -> DataFrame:
    """As :func:`build_vocabulary`, from ``(word, count)`` already aggregated
    (e.g. summed from a term-frequency table, so the corpus is tokenised once)."""
    kept = (counts.select(word_col, F.col(count_col).cast("long").alias("count"))
                  .filter(F.col("count") >= min_count))
    vocab = dense_index(kept, [F.col("count").desc(), F.col(word_col)], "idx")
    if max_size is not None:
        vocab = vocab.filter(F.col("idx") < max_size)
    return vocab


def counts_from_tf(tf: DataFrame, word_col: str = "word") -> DataFrame:
    return tf.groupBy(word_col).agg(F.sum("tf").cast("long").alias("count"))


def vectors_by_block(words: DataFrame, vectors: DataFrame, word_col: str = "word") -> DataFrame:
    """The word vectors each block needs: ``vectors`` once for every block among the
    ``(_block, word)`` of ``words`` that holds the word."""
    return words.select("_block", word_col).distinct().join(vectors, word_col, "inner")


def lookup_word_vectors(tokens: DataFrame, vectors: DataFrame, word_col: str = "word", id_col: str = "doc_id",
                        blocks: int | None = None) -> DataFrame:
    """Inner lookup: unknown words drop out, repeats stay.

    Tokens meet the vectors by block of documents and word, so a frequent word is cut
    into as many groups as there are blocks and no task gets all its tokens. The
    vectors of a part are looked up in a hash table: its tokens are never sorted or held.
    """
    blocks = blocks or max(LEAST_BLOCKS, tokens.rdd.getNumPartitions())
    dealt, known = tokens.withColumn("_block", block_of(id_col, blocks)), ["_block", word_col]
    needed = vectors_by_block(dealt, vectors, word_col).repartition(4 * blocks, *known)
    return dealt.repartition(4 * blocks, *known).join(needed.hint("shuffle_hash"), known, "inner").drop("_block")


def term_frequencies(tokens: DataFrame, id_col: str = "doc_id", word_col: str = "word") -> DataFrame:
    """``(doc_id, word, tf)``: shrinks long documents before the vector join."""
    return tokens.groupBy(id_col, word_col).agg(F.count(F.lit(1)).cast("double").alias("tf"))


def mean_embedding(docs: DataFrame, tokens: DataFrame, vectors: DataFrame, dim,
                   id_col: str = "doc_id", word_col: str = "word", vector_col: str = "vector",
                   out_col: str = "features") -> DataFrame:
    """See :func:`mean_embedding_tf`; ``tokens`` is the long token form."""
    return mean_embedding_tf(docs, term_frequencies(tokens, id_col, word_col), vectors, dim,
                             id_col, word_col, vector_col, out_col)


def vector_width(vectors: DataFrame, vector_col: str = "vector"):
    """Width of the vector table as a scalar subquery (no driver round trip)."""
    return vectors.select(F.coalesce(F.max(F.size(vector_col)), F.lit(0))).scalar()


class _BlockSums:
    """Weighted sums of word vectors for the documents of one block. Rows come as the
    documents (no word), then by word: its vectors, then its term frequencies."""

    def __init__(self, block: int):
        self.block, self.ids, self.own, self.sums, self.weights = block, [], None, None, None
        self.word, self.vector, self.times = None, None, 0.0

    def _slots(self, ids: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(ids, value_set=self.own), -1).to_numpy(zero_copy_only=False)

    def _close(self) -> None:
        if self.own is None:
            ids = pa.concat_arrays(self.ids) if self.ids else pa.nulls(0)
            self.own = pc.unique(pc.drop_null(ids))
            self.weights = np.zeros(len(self.own))

    def _vectors(self, lists: pa.Array) -> np.ndarray:
        values = lists.flatten()
        width = len(values) // max(1, len(lists)) if self.sums is None else self.sums.shape[1]
        if lists.null_count or values.null_count or (pc.list_value_length(lists).to_numpy(zero_copy_only=False) != width).any():
            raise ValueError("word vectors must have one width and hold no null")
        if self.sums is None:
            self.sums = np.zeros((len(self.own), width))
        return values.to_numpy(zero_copy_only=False).reshape(-1, width)

    def add(self, part: pa.RecordBatch) -> None:
        kind = part.column("_kind").to_numpy()
        docs = int(np.count_nonzero(kind == _DOC))
        if docs:
            self.ids.append(part.column("_id").slice(0, docs))
            part, kind = part.slice(docs), kind[docs:]
        if not len(kind):
            return
        self._close()
        words = part.column("_word")
        new = np.r_[words[0].as_py() != self.word, pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)]
        place = np.cumsum(new)  # 0: still the word that the last rows ended with
        given = kind == _VECTOR
        lists = part.column("_vec").filter(pa.array(given))
        read = self._vectors(lists) if len(lists) else None
        if self.sums is not None:
            known, times = np.zeros((place[-1] + 1, self.sums.shape[1])), np.zeros(place[-1] + 1)
            if self.times:
                known[0], times[0] = self.vector, self.times
            if read is not None:
                at = place[given]
                if times[at[0]] or (np.diff(at) == 0).any():  # a word with several vectors
                    np.add.at(known, at, read)
                    np.add.at(times, at, 1.0)
                else:
                    known[at], times[at] = read, 1.0
            self._weigh(part, place, known, times, kind == _TF)
            self.vector, self.times = known[-1].copy(), times[-1]
        self.word = words[-1].as_py()

    def _weigh(self, part: pa.RecordBatch, place: np.ndarray, known: np.ndarray, times: np.ndarray, counted: np.ndarray) -> None:
        slots = self._slots(part.column("_id"))
        rows = np.flatnonzero(counted & (slots >= 0) & (times[place] > 0))
        if not len(rows):
            return
        rows = rows[np.argsort(slots[rows], kind="stable")]
        slots, place, tf = slots[rows], place[rows], part.column("_tf").to_numpy(zero_copy_only=False)[rows]
        starts = np.flatnonzero(np.r_[True, np.diff(slots) > 0])
        self.sums[slots[starts]] += np.add.reduceat(known[place] * tf[:, None], starts, axis=0)
        self.weights[slots[starts]] += np.add.reduceat(times[place] * tf, starts)

    def rows(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        self._close()
        width = 0 if self.sums is None else self.sums.shape[1]
        for ids in self.ids:
            for at in range(0, len(ids), OUT_ROWS):
                some = ids.slice(at, OUT_ROWS)
                slots = self._slots(some)
                has = slots >= 0
                has[has] = self.weights[slots[has]] > 0
                means = self.sums[slots[has]] / self.weights[slots[has]][:, None] if has.any() else np.zeros((0, width))
                ends = np.r_[0, np.cumsum(has * width)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(means.ravel(), pa.float64()), mask=pa.array(~has))
                yield pa.RecordBatch.from_arrays([some, lists], names=names)


def _block_means(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("_block")
            held = _BlockSums(block[0].as_py()) if held is None else held
            if pc.any(pc.not_equal(block, held.block)).as_py():
                raise ValueError("a part must hold one block")
            held.add(batch)
        if held is not None:
            yield from held.rows(names)
    return run


def mean_embedding_tf(docs: DataFrame, tf: DataFrame, vectors: DataFrame, dim=None,
                      id_col: str = "doc_id", word_col: str = "word", vector_col: str = "vector",
                      out_col: str = "features") -> DataFrame:
    """Occurrence-weighted mean of the known-word vectors per document.

    Only known words count in the divisor; a document with none (or no
    tokens at all) gets the zero vector. Documents are dealt into blocks, and a block
    gets the vectors of its own words once each. Its rows are read in word order, so a
    task holds one word's vector and the sums of its documents, and neither a vector
    for each term nor a partial sum for each document and task is ever shuffled.
    """
    blocks, id_type = document_blocks(docs), docs.schema[id_col].dataType
    none = F.lit(None)

    def rows(df, kind, id=none, word=none, tf=none, vec=none):
        return df.select("_block", F.lit(kind).alias("_kind"), id.cast(id_type).alias("_id"), word.cast("string").alias("_word"),
                         tf.cast("double").alias("_tf"), vec.cast("array<double>").alias("_vec"))
    counted = (tf.where(F.col(id_col).isNotNull() & F.col(word_col).isNotNull()).withColumn(id_col, F.col(id_col).cast(id_type))
                 .withColumn("_block", block_of(id_col, blocks)))
    met = (rows(docs.select(F.col(id_col), block_of(id_col, blocks).alias("_block")), _DOC, F.col(id_col))
           .unionByName(rows(vectors_by_block(counted, vectors.select(word_col, vector_col), word_col), _VECTOR,
                             word=F.col(word_col), vec=F.col(vector_col)))
           .unionByName(rows(counted, _TF, F.col(id_col), F.col(word_col), F.col("tf"))))
    dealt = met.repartitionById(blocks, F.col("_block")).sortWithinPartitions("_word", "_kind")
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("_mean", T.ArrayType(T.DoubleType()))])
    means = dealt.mapInArrow(_block_means([id_col, "_mean"]), schema)
    width = vector_width(vectors, vector_col) if dim is None else dim
    return means.select(id_col, F.coalesce("_mean", F.array_repeat(F.lit(0.0), width)).alias(out_col))


def text_blocks(docs: DataFrame, text_col: str = "text") -> int:
    """Number of blocks the texts are dealt into, in proportion to their bytes."""
    held = docs.select(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 64)).first()[0]
    return max(LEAST_BLOCKS, math.ceil((held or 0) / BLOCK_TEXT))


def word_counts_by_block(docs: DataFrame, cut: Callable[[str], Column], blocks: int, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """``(_block, word, count)``. Texts are dealt by block and ``cut`` into words there, so
    only the distinct words of a block are moved."""
    dealt = docs.select(id_col, text_col).repartition(blocks, id_col)
    words = dealt.select(block_of(id_col, blocks).alias("_block"), F.explode(cut(text_col)).alias("word"))
    return words.groupBy("_block", "word").agg(F.count(F.lit(1)).alias("count"))


class _TextMeans:
    """Mean vectors of the documents of one block. Rows come as the word vectors, held in a
    table, then the documents by id, passed on as read. Rows of one id share their words."""

    def __init__(self, block: int, names: list[str]):
        self.block, self.names, self.given, self.table = block, names, [], None
        self.words, self.times, self.last = None, None, None

    def _vectors(self, part: pa.RecordBatch) -> None:
        for name, kind in (("_vec", np.float64), ("_single", np.float32)):
            own = part.filter(pc.is_valid(part.column("_single")) if kind is np.float32 else pc.is_null(part.column("_single")))
            if not own.num_rows:
                continue
            lists = own.column(name)
            values = lists.flatten()
            width = self.given[0][1].shape[1] if self.given else len(values) // len(lists)
            if lists.null_count or values.null_count or (pc.list_value_length(lists).to_numpy(zero_copy_only=False) != width).any():
                raise ValueError("word vectors must have one width and hold no null")
            self.given.append((own.column("_word"), values.to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind, copy=False)))

    def _close(self) -> None:
        if self.words is not None:
            return
        self.words, self.times, self.table = pa.array([], pa.string()), np.zeros(0), np.zeros((0, 0))
        if self.given:
            every = pa.concat_arrays([w for w, _ in self.given])
            held = np.empty((len(every), self.given[0][1].shape[1]), np.result_type(*(v.dtype for _, v in self.given)))
            for at in np.cumsum([len(w) for w, _ in self.given])[::-1]:
                own = self.given.pop()[1]
                held[at - len(own):at] = own
            self.words, self.times, self.table = pc.unique(every), np.ones(len(every)), held
            if len(self.words) < len(every):  # words with several vectors
                at = pc.index_in(every, value_set=self.words).to_numpy()
                self.table, self.times = np.zeros((len(self.words), held.shape[1])), np.bincount(at).astype(np.float64)
                np.add.at(self.table, at, held)

    def add(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vectors = int(np.count_nonzero(part.column("_kind").to_numpy() == _VECTOR))
        if vectors:
            self._vectors(part.slice(0, vectors))
        if vectors < part.num_rows:
            self._close()
            for at in range(vectors, part.num_rows, TEXTS_AT_ONCE):
                yield from self._documents(part.slice(at, TEXTS_AT_ONCE))

    def _documents(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, lists = part.column("_id"), part.column("_words")
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        goes_on = self.last is not None and self.last[0][0].is_valid and ids[0] == self.last[0][0]
        new = np.r_[not goes_on, pc.fill_null(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)), True).to_numpy(zero_copy_only=False)]
        place = np.cumsum(new)  # 0: still the id that the last rows ended with
        sums, weights = np.zeros((place[-1] + 1, self.table.shape[1])), np.zeros(place[-1] + 1)
        held = 0
        if self.last is not None:
            before, sums[0], weights[0] = self.last
            ids, place, held = pa.concat_arrays([before, ids]), np.r_[np.zeros(len(before), place.dtype), place], len(before)
        word = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.words), -1).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.where(known, place[held:], -1), lengths)
        met = (word >= 0) & (owner >= 0)
        word, owner = word[met], owner[met]
        weights += np.bincount(owner, self.times[word], len(weights))
        for at in range(0, len(word), TOKENS_AT_ONCE):
            some = owner[at:at + TOKENS_AT_ONCE]
            starts = np.flatnonzero(np.r_[True, np.diff(some) > 0])
            sums[some[starts]] += np.add.reduceat(self.table[word[at:at + TOKENS_AT_ONCE]].astype(np.float64, copy=False), starts, axis=0)
        done = int(np.searchsorted(place, place[-1]))
        self.last = (ids.slice(done), sums[-1], weights[-1])
        yield from self._rows(ids.slice(0, done), place[:done], sums, weights)

    def _rows(self, ids: pa.Array, place: np.ndarray, sums: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(ids), OUT_ROWS):
            own = place[at:at + OUT_ROWS]
            has = weights[own] > 0
            means = sums[own[has]] / weights[own[has]][:, None]
            ends = np.r_[0, np.cumsum(has * sums.shape[1])]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(means.ravel(), pa.float64()), mask=pa.array(~has))
            yield pa.RecordBatch.from_arrays([ids.slice(at, OUT_ROWS), lists], names=self.names)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.last is not None:
            ids, total, weight = self.last
            yield from self._rows(ids, np.zeros(len(ids), int), total[None, :], np.array([weight]))


def _text_means(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("_block")
            held = _TextMeans(block[0].as_py(), names) if held is None else held
            if pc.any(pc.not_equal(block, held.block)).as_py():
                raise ValueError("a part must hold one block")
            yield from held.add(batch)
        if held is not None:
            yield from held.rest()
    return run


def mean_embedding_texts(docs: DataFrame, cut: Callable[[str], Column], vectors: DataFrame, counts: DataFrame, blocks: int, dim=None,
                         id_col: str = "doc_id", text_col: str = "text", word_col: str = "word", vector_col: str = "vector",
                         out_col: str = "features") -> DataFrame:
    """As :func:`mean_embedding_tf` over the words that ``cut`` gives for the texts.

    ``counts`` is :func:`word_counts_by_block` of the same texts and blocks. A block gets
    its texts and, once each, the vectors of its words, in single precision where that is
    exact; texts are cut into words only there. So a text, not its terms, is shuffled,
    and a task holds the vectors of one block's words and passes its documents on.
    """
    id_type, none = docs.schema[id_col].dataType, F.lit(None)
    exact = F.coalesce(F.forall("_vec", lambda x: x.eqNullSafe(x.cast("float").cast("double"))), F.lit(False))
    table = vectors.select(F.col(word_col).cast("string").alias("word"), F.col(vector_col).cast("array<double>").alias("_vec")).select(
        "word", F.when(~exact, F.col("_vec")).alias("_vec"), F.when(exact, F.col("_vec").cast("array<float>")).alias("_single"))

    def rows(df, kind, block, id=none, text=none, word=none, vec=none, single=none):
        return df.select(block.alias("_block"), F.lit(kind).alias("_kind"), id.cast(id_type).alias("_id"), text.cast("string").alias("_text"),
                         word.cast("string").alias("_word"), vec.cast("array<double>").alias("_vec"), single.cast("array<float>").alias("_single"))
    needed = counts.select("_block", "word").join(table, "word", "inner")
    met = (rows(docs, _TEXT, block_of(id_col, blocks), F.col(id_col), F.col(text_col))
           .unionByName(rows(needed, _VECTOR, F.col("_block"), word=F.col("word"), vec=F.col("_vec"), single=F.col("_single"))))
    dealt = met.repartitionById(blocks, F.col("_block")).sortWithinPartitions("_kind", "_id")
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("_mean", T.ArrayType(T.DoubleType()))])
    means = (dealt.select("_block", "_kind", "_id", "_word", "_vec", "_single", cut("_text").alias("_words"))
             .mapInArrow(_text_means([id_col, "_mean"]), schema))
    width = vector_width(vectors, vector_col) if dim is None else dim
    return means.select(id_col, F.coalesce("_mean", F.array_repeat(F.lit(0.0), width)).alias(out_col))


def attach_label_list(vectors: DataFrame, lists: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Inner join: a document without a label list drops out instead of failing."""
    return vectors.join(lists, id_col, "inner")
