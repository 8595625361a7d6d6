"""The query registry: one plan per operator of the inventory.

Every query reads the driver tables (or data Spark derives from them) in
full. Array results are rendered as delimited strings and doubles are
rounded, so that an order-insensitive value hash can compare them with the
SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import patterns as P
from ..functions import text as T
from ..operators import batching as B
from ..operators import evaluate as E
from ..operators import graph as G
from ..operators import labels as L
from ..operators import linear as LN
from ..operators import pages as PG
from ..operators import text as TX
from ..operators import vectors as V
from ..session import materialize, scratch_path
from ..sinks import vector_store as VS
from ..sinks import writers as W
from ..sources import artifacts as SA
from ..sources import category as SC
from ..sources import dump as SD
from ..sources import files as SF
from . import fixtures as FX

DIGITS = 6  # rounding of doubles in results compared with the oracle


def _t(spark, sf, name):
    return FX.table(spark, sf, name)


def _ints(c) -> F.Column:
    """Integer array -> 'a,b,c' ('' for an empty array)."""
    return F.array_join(F.transform(F.col(c) if isinstance(c, str) else c,
                                    lambda x: x.cast("string")), ",")


def _r(c) -> F.Column:
    """Round for the value hash; ``+ 0.0`` turns a rounded -0.0 into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, DIGITS) + F.lit(0.0)


def _label_lists(spark, sf, with_doc_fields=True):
    links = FX.label_links(spark, sf, with_doc_fields)
    ids = _t(spark, sf, "documents").select("doc_id")
    return links, L.labels_by_id(ids, links)


def _encoded(spark, sf, with_doc_fields=True):
    links, lists = _label_lists(spark, sf, with_doc_fields)
    codes = L.label_dictionary(links)
    return L.encode_labels(lists, codes)


def _doc_vectors(spark, sf):
    """Documents -> mean word vectors. The words of each block of documents feed
    both the vocabulary counts and the choice of vectors a block needs."""
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    blocks = V.text_blocks(docs)
    counts = materialize(V.word_counts_by_block(docs, T.tokenize, blocks), "word-counts")
    vocab = V.vocabulary_from_counts(counts.groupBy("word").agg(F.sum("count").alias("count")))
    w1 = FX.word_vectors(spark, sf, vocab)
    return V.mean_embedding_texts(docs, T.tokenize, w1, counts, blocks)


def _emb_scored(spark, sf):
    emb = FX.embedding_rows(spark, sf)
    return LN.predict(emb, FX.class_weights(spark, sf))


# ---------------------------------------------------------------- sources ---

def scan_dump_xml(spark, sf):
    path = FX.write_dump(FX.pages_as_dump_rows(spark, sf), scratch_path(spark, "dump"))
    return SD.scan_dump(spark, path).select("id", "title", "text")


def scan_id_list(spark, sf):
    ids = (_t(spark, sf, "documents").select(F.col("doc_id").alias("page_id"))
           .unionByName(_t(spark, sf, "labels").select(F.col("doc_id").alias("page_id"))))
    path = scratch_path(spark, "ids")
    W.write_id_list(ids, path)
    return SF.scan_id_list(spark, path)


def _docs_as_files(spark, sf):
    """All documents as one folder of ``id_<id>.txt`` files."""
    docs = _t(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), "text")
    path = scratch_path(spark, "docfiles")
    W.write_documents(docs, path, fmt="files")
    return path


def scan_doc_lines(spark, sf):
    return SF.scan_doc_lines(spark, _docs_as_files(spark, sf), strip_final_newline=False) \
        .select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


def scan_documents(spark, sf):
    return SF.scan_documents(spark, _docs_as_files(spark, sf))


def scan_category_tables(spark, sf):
    page, links = FX.category_graph(spark, sf)
    root = scratch_path(spark, "category")
    page.write.mode("overwrite").parquet(root + "/page")
    links.write.mode("overwrite").parquet(root + "/categorylinks")
    page2, links2 = SC.scan_category_tables(spark, root + "/page", root + "/categorylinks")
    return G.resolve_titles(links2, page2, "cl_from", "from_title") \
        .select("cl_from", "cl_to", "cl_type", "from_title")


def load_artifacts(spark, sf):
    """All three artifacts, written and read back: label lists, codes and word vectors."""
    root = scratch_path(spark, "artifacts")
    W.write_artifacts({"train_data": _encoded(spark, sf), "category_codes": L.label_dictionary(FX.label_links(spark, sf)),
                       "word_vectors": FX.word_vectors(spark, sf)}, root)
    back = SA.load_artifacts(spark, root)
    none = F.lit(None)
    vsum = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v)
    return (back["train_data"].select(F.lit("train_data").alias("artifact"), F.col("doc_id").cast("string").alias("name"),
                                      _ints("codes").alias("codes"), none.cast("double").alias("total"))
            .unionByName(back["category_codes"].select(F.lit("category_codes").alias("artifact"), F.col("label").alias("name"),
                                                       F.col("code").cast("string").alias("codes"), none.cast("double").alias("total")))
            .unionByName(back["word_vectors"].select(F.lit("word_vectors").alias("artifact"), F.col("word").alias("name"),
                                                     none.cast("string").alias("codes"), _r(vsum).alias("total"))))


# ------------------------------------------------------------------ sinks ---

def write_id_list(spark, sf):
    page, links = FX.category_graph(spark, sf)
    pages = G.category_descent(links, page, [FX.ROOT_CATEGORY], 3)
    path = scratch_path(spark, "ids")
    W.write_id_list(pages, path)
    return SF.scan_id_list(spark, path)


def write_documents(spark, sf):
    docs = _t(spark, sf, "documents")
    path = scratch_path(spark, "documents")
    W.write_documents(docs, path)
    return spark.read.parquet(path).select("doc_id", "text", "lang", "source", "n_chars")


def write_artifacts(spark, sf):
    links = FX.label_links(spark, sf)
    root = scratch_path(spark, "artifacts")
    W.write_artifacts({"category_codes": L.label_dictionary(links)}, root)
    return SA.load_artifact(spark, root, "category_codes").select(
        "label", F.col("code").cast("long").alias("code"))


def write_metrics(spark, sf):
    hist = _history(spark, sf)
    path = scratch_path(spark, "metrics")
    W.write_metrics(hist.select("run", "iteration", F.lit("loss").alias("metric"),
                                F.col("loss").alias("value")), path)
    best = E.best_iteration(hist)
    W.write_metrics(best.select("run", F.col("best_iteration").alias("iteration"),
                                F.lit("best_loss").alias("metric"), F.col("best_loss").alias("value")), path)
    return spark.read.parquet(path).select(F.col("run").cast("long").alias("run"), "iteration",
                                           "metric", "value")


# ------------------------------------------------ projections and filters ---

def doc_id_from_path(spark, sf):
    ids = _t(spark, sf, "documents").select("doc_id")
    names = (ids.select("doc_id", T.file_name_from_doc_id("doc_id").alias("file_name"))
             .unionByName(ids.select("doc_id", F.concat(F.lit("id_"), F.col("doc_id").cast("string"))
                                     .alias("file_name")))
             .unionByName(ids.select("doc_id", F.concat(F.lit("id_"), F.col("doc_id").cast("string"),
                                                        F.lit(".tar.gz")).alias("file_name")))
             .unionByName(ids.select("doc_id", F.concat(F.lit("id_x"), F.col("doc_id").cast("string"),
                                                        F.lit(".txt")).alias("file_name"))))
    return names.select("doc_id", "file_name",
                        T.doc_id_from_file_name("file_name").cast("string").alias("parsed_id"))


def path_from_doc_id(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", T.file_name_from_doc_id("doc_id").alias("file_name"))


LOOKUP_DOC_ID = 42


def get_doc_by_id(spark, sf):
    """One document's words without stop words, as they are and as lemmas. Only its own
    words meet the lexicon, which is the corpus's distinct words."""
    docs = PG.get_doc_by_id(_t(spark, sf, "documents"), LOOKUP_DOC_ID).select("doc_id", "text")
    own = TX.tokens_long(docs, stop_words=P.ENGLISH_STOP_WORDS)
    lemmas = TX.noun_lemma_map(own.select("word").distinct(), FX.document_tokens(spark, sf).select("word").distinct(), distinct=True)
    both = own.join(lemmas, "word", "left")
    ordered = both.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "lemma"))).alias("t"))
    return ordered.select("doc_id", F.array_join(F.transform("t", lambda r: r["word"]), " ").alias("words"),
                          F.array_join(F.transform("t", lambda r: F.coalesce(r["lemma"], r["word"])), " ").alias("lemmas"))


def _stored_vectors(spark, sf):
    path = scratch_path(spark, "vector-store")
    # stored first: dealing them by ranges reads them twice
    VS.write_vectors(materialize(_doc_vectors(spark, sf), "doc-vectors"), path)
    return path


def _dims(vectors):
    return vectors.select("doc_id", F.posexplode("features").alias("dim", "value")).select(
        "doc_id", F.col("dim").cast("long").alias("dim"), _r("value").alias("value"))


def get_vector_by_id(spark, sf):
    return _dims(VS.read_vector(spark, _stored_vectors(spark, sf), LOOKUP_DOC_ID))


def take_vector_page(spark, sf):
    return _dims(VS.read_page(spark, _stored_vectors(spark, sf), TAKE_AFTER, TAKE_N))


def edge_kind_filter(spark, sf):
    _, links = FX.category_graph(spark, sf)
    return G.edge_kind_filter(links, G.PAGE)


def page_level_id(spark, sf):
    path = FX.write_dump(FX.pages_as_dump_rows(spark, sf), scratch_path(spark, "dump"))
    wanted = _t(spark, sf, "labels").select("doc_id")
    return PG.semi_join_ids(SD.scan_dump(spark, path), wanted, "id").select("id", "title")


def drop_incomplete_pages(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    joined = docs.join(_t(spark, sf, "labels"), "doc_id", "left")
    return PG.drop_incomplete(joined, ["doc_id", "text", "quality"]).select(
        "doc_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))


def drop_blank_lines(spark, sf):
    return FX.spliced_documents(spark, sf).select("doc_id", T.drop_blank_lines("text").alias("text"))


def remove_stopwords(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    toks = TX.token_lists(docs, stop_words=P.ENGLISH_STOP_WORDS)
    return toks.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"),
                       F.array_join("tokens", " ").alias("tokens"))


# ------------------------------------------------------------------ joins ---

def semi_join_ids(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "n_chars")
    return PG.semi_join_ids(docs, _t(spark, sf, "labels").select("doc_id"), "doc_id")


def resolve_titles(spark, sf):
    page, links = FX.category_graph(spark, sf)
    sub = G.edge_kind_filter(links, G.SUBCAT).select("cl_from", "cl_to")
    return G.resolve_titles(sub, page, "cl_from", "child_title")


def category_members(spark, sf):
    page, links = FX.category_graph(spark, sf)
    frontier = _t(spark, sf, "nation").select(F.col("n_name").alias("category"))
    return G.category_members(frontier, links, page)


def labels_by_id(spark, sf):
    _, lists = _label_lists(spark, sf, with_doc_fields=False)
    return lists.select("doc_id", F.array_join("labels", "|").alias("labels"))


def encode_labels(spark, sf):
    return _encoded(spark, sf).select("doc_id", _ints("codes").alias("codes"))


def lookup_word_vectors(spark, sf):
    # the tokens are stored: the vocabulary and the lookup read them, the texts are cut once
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    blocks = V.document_blocks(docs)
    tokens = materialize(TX.tokens_long(V.by_document(docs, blocks=blocks)), "tokens")
    vocab = V.build_vocabulary(tokens)
    w1 = FX.word_vectors(spark, sf, vocab)
    known = V.lookup_word_vectors(tokens, w1, blocks=blocks)
    return known.select("doc_id", F.col("pos").cast("long").alias("pos"), "word")


def attach_label_list(spark, sf):
    vecs = _doc_vectors(spark, sf)
    joined = V.attach_label_list(vecs, _encoded(spark, sf))
    vsum = F.aggregate("features", F.lit(0.0), lambda a, v: a + v)
    return joined.select("doc_id", _ints("codes").alias("codes"), _r(vsum).alias("vsum"))


# ------------------------------------------------------------------ graph ---

def category_descent(spark, sf):
    page, links = FX.category_graph(spark, sf)
    return G.category_descent(links, page, [FX.ROOT_CATEGORY], 3)


def category_descent_partial(spark, sf):
    """Two seeds, two steps: one seed is a region, the other a nation, so most
    pages stay out of reach."""
    page, links = FX.category_graph(spark, sf)
    return G.category_descent(links, page, list(FX.PARTIAL_SEEDS), 1)


# ----------------------------------------------------------- aggregations ---

def label_dictionary(spark, sf):
    return L.label_dictionary(FX.label_links(spark, sf)).select(
        "label", F.col("code").cast("long").alias("code"))


def count_labels(spark, sf):
    return L.count_labels(FX.label_links(spark, sf))


def _clean_tokens(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    return TX.tokens_long(TX.clean_documents(docs), stop_words=P.ENGLISH_STOP_WORDS)


def total_words(spark, sf):
    return TX.total_words(_clean_tokens(spark, sf))


def label_list_stats(spark, sf):
    st = L.label_list_stats(_encoded(spark, sf, with_doc_fields=False))
    return st.select("n_samples", "max_len", _r("mean_len").alias("mean_len"))


def corpus_counts(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id")
    asked = _t(spark, sf, "labels").select("doc_id").distinct()
    found = asked.join(docs.withColumn("_hit", F.lit(1)), "doc_id", "left")
    links = FX.label_links(spark, sf)
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    n_cats = links.select(F.count_distinct("label")).scalar()
    n_lab = links.select(F.count_distinct("doc_id")).scalar()
    return found.agg(
        n_docs.cast("long").alias("n_documents"),
        F.count(F.lit(1)).cast("long").alias("n_asked"),
        F.count("_hit").cast("long").alias("n_found"),
        n_lab.cast("long").alias("n_labeled"),
        n_cats.cast("long").alias("n_categories"))


def build_vocabulary(spark, sf):
    return FX.vocabulary(spark, sf).select("word", F.col("count").cast("long").alias("n"), "idx")


def clean_corpus_vocabulary(spark, sf):
    """The flagship: clean -> tokenize -> stop words -> vocabulary."""
    return V.build_vocabulary(_clean_tokens(spark, sf)).select(
        "word", F.col("count").cast("long").alias("n"), "idx")


def lemma_corpus_vocabulary(spark, sf):
    """The full token pipeline: clean -> tokenize -> stop words -> noun
    lemmas (lexicon = the corpus's own words) -> vocabulary."""
    # Counts, not tokens, go through the lemma map: words are counted once
    # (map-side combined), each distinct word is mapped, and counts are summed
    # per lemma — the token stream is never joined, so frequent words cannot
    # skew a join.
    counts = materialize(_clean_tokens(spark, sf).groupBy("word").agg(F.count(F.lit(1)).alias("count")), "word-counts")
    lemma_counts = (TX.noun_lemma_map(counts, counts, distinct=True)
                          .groupBy(F.col("lemma").alias("word")).agg(F.sum("count").alias("count")))
    return V.vocabulary_from_counts(lemma_counts).select(
        "word", F.col("count").cast("long").alias("n"), "idx")


def mean_embedding(spark, sf):
    vecs = _doc_vectors(spark, sf)
    return vecs.select("doc_id", F.posexplode_outer("features").alias("dim", "value")).select(
        "doc_id", F.col("dim").cast("long").alias("dim"), _r("value").alias("value"))


BATCH = P.MLP_BATCH


def reduce_mean(spark, sf):
    scored = _emb_scored(spark, sf)
    batched = B.assign_batches(scored.select("vec_id", "pred", "label"), [F.col("vec_id")], BATCH)
    per_batch = batched.groupBy("batch_id").agg(
        F.avg((F.col("pred") != F.col("label")).cast("double")).alias("err"))
    return E.reduce_mean(per_batch, "err", "mean_batch_error").select(_r("mean_batch_error").alias("mean_batch_error"))


def weight_norms(spark, sf):
    return LN.weight_norms(FX.class_weights(spark, sf)).select(_r("l1").alias("l1"), _r("l2_sq").alias("l2_sq"))


# ---------------------------------------------------------------- windows ---

def _history(spark, sf):
    ev = _t(spark, sf, "events")
    return ev.select(F.col("user_id").alias("run"), F.col("event_id").alias("iteration"),
                     F.col("value").alias("loss"))


def best_checkpoint(spark, sf):
    return E.best_checkpoint(_history(spark, sf))


def best_iteration(spark, sf):
    return E.best_iteration(_history(spark, sf))


# ------------------------------------------------------------- sort / top ---

def argmax_class(spark, sf):
    emb = FX.embedding_rows(spark, sf)
    scored = LN.dense_layer(emb, FX.class_weights(spark, sf), "features", "scores", activation=None)
    return scored.select("vec_id", A.argmax(A.softmax("scores")).cast("long").alias("pred"))


TAKE_AFTER, TAKE_N = 100, 50


def take_batch(spark, sf):
    return B.take_batch(_t(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", TAKE_AFTER, TAKE_N)


# ---------------------------------------------------------------- set ops ---

def union_distinct_pages(spark, sf):
    page, links = FX.category_graph(spark, sf)
    pages = G.edge_kind_filter(links, G.PAGE)
    sup = pages.filter(F.col("cl_from") < F.lit(FX.ORDER_BASE)).select(F.col("cl_from").alias("page_id"))
    order = pages.filter(F.col("cl_from") >= F.lit(FX.ORDER_BASE)).select(F.col("cl_from").alias("page_id"))
    return G.union_distinct([sup, order, sup])


def distinct_ids(spark, sf):
    return _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()


# ---------------------------------------------------------- string scalars ---

def strip_numeric_brackets(spark, sf):
    return FX.spliced_documents(spark, sf).select("doc_id", T.strip_numeric_brackets("text").alias("text"))


def strip_category_prefix(spark, sf):
    return FX.spliced_documents(spark, sf).select("doc_id", T.strip_category_prefix("text").alias("text"))


def clean_document(spark, sf):
    return FX.spliced_documents(spark, sf).select("doc_id", T.clean_document("text").alias("text"))


def tokenize(spark, sf):
    toks = TX.token_lists(_t(spark, sf, "documents").select("doc_id", "text"))
    return toks.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"),
                       F.array_join("tokens", " ").alias("tokens"))


def lemmatize_nouns(spark, sf):
    """Lemmas of every document with their number. Term frequencies, not tokens, meet
    the lemma map, so a frequent word is one row per document there."""
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    tf = V.term_frequencies(TX.tokens_long(V.by_document(docs)))
    # the corpus words are both the words to map and the lexicon
    words = materialize(TX.tokens_long(docs).select("word").distinct(), "words")
    lemmas = materialize(TX.changed_lemmas(words, words), "lemmas")
    return (TX.lemmatize_long(tf, lemmas).groupBy("doc_id", F.col("word").alias("lemma"))
            .agg(F.sum("tf").cast("long").alias("n")))


def markup_to_plain(spark, sf):
    return _t(spark, sf, "pages").select("page_id", T.html_to_plain("html").alias("plain"))


def compose_document(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", T.compose_document("p_name", "p_type").alias("doc"))


def decode_bytes(spark, sf):
    docs = _t(spark, sf, "documents")
    return docs.select("doc_id", T.decode_utf8(F.encode("text", "UTF-8")).alias("utf8"),
                       T.ascii_only("text").alias("ascii"))


# ----------------------------------------------------------- array / math ---

def pad_label_list(spark, sf):
    padded = L.pad_label_list(_encoded(spark, sf, with_doc_fields=False))
    return padded.select("doc_id", _ints("padded").alias("padded"))


def _units_long(df, col):
    # posexplode_outer: the non-outer form makes the optimizer add a
    # size(...) > 0 filter that re-evaluates the whole array expression.
    return df.select("vec_id", F.posexplode_outer(col).alias("unit", "value")).select(
        "vec_id", F.col("unit").cast("long").alias("unit"), _r("value").alias("value"))


def dense_layer(spark, sf):
    emb = FX.embedding_rows(spark, sf)
    hidden = LN.dense_layer(emb, FX.class_weights(spark, sf), "features", "hidden", activation="tanh")
    return _units_long(hidden, "hidden")


def zero_one_multilabel_error(spark, sf):
    scored = _emb_scored(spark, sf).withColumn("codes", F.array(F.col("label")))
    return E.zero_one_multilabel_error(scored, "pred", "codes").select(_r("error").alias("error"))


def softmax(spark, sf):
    return _units_long(_emb_scored(spark, sf), "probs")


def mean_nll(spark, sf):
    return E.mean_nll(_emb_scored(spark, sf), "probs", "label").select(_r("nll").alias("nll"))


CONV_PARTS, CONV_POOL = 4, 4


def conv_filters(spark, sf, parts=CONV_PARTS):
    """Filters from P1: the whole weights of every class, cut into ``parts`` filters each."""
    p1 = FX.class_weights(spark, sf)
    width = (F.size("w") / parts).cast("int")
    return p1.select("unit", "w", "b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).select(
        (F.col("unit") * parts + F.col("part")).alias("unit"), F.array(F.slice("w", F.col("part") * width + 1, width)).alias("w"), "b")


def conv_pool_1d(spark, sf):
    emb = FX.embedding_rows(spark, sf).withColumn("maps", F.array(F.col("features")))
    out = LN.conv_layer(emb, conv_filters(spark, sf), "maps", "pooled", CONV_POOL)
    return (out.select("vec_id", F.posexplode_outer("pooled").alias("filter", "vals"))
               .select("vec_id", "filter", F.posexplode_outer("vals").alias("pos", "value"))
               .select("vec_id", F.col("filter").cast("long").alias("filter"),
                       F.col("pos").cast("long").alias("pos"), _r("value").alias("value")))


def batch_count(spark, sf):
    n = _t(spark, sf, "documents").select(F.count(F.lit(1))).scalar()
    sizes = spark.createDataFrame([(s,) for s in (P.LOGISTIC_BATCH, P.MLP_BATCH, P.CONV_BATCH)],
                                  "batch_size long")
    return sizes.select("batch_size", B.batch_count(n, F.col("batch_size")).alias("n_batches"))


# --------------------------------------------------------------- ml / flow ---

def explode_pairs(spark, sf):
    pairs = L.explode_pairs(_encoded(spark, sf, with_doc_fields=False))
    return pairs.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("code").cast("long").alias("code"))


def assign_batches(spark, sf):
    pairs = L.explode_pairs(_encoded(spark, sf)).select("doc_id", "pos", "code")
    out = B.assign_batches(pairs, [F.col("doc_id"), F.col("pos")], P.LOGISTIC_BATCH)
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("code").cast("long").alias("code"),
                      "idx", "batch_id")


def assemble_batches(spark, sf):
    """Every batch with its matrices; the feature matrix as its sum weighted by row and
    column numbers."""
    out = B.assemble_batches(_doc_vectors(spark, sf), _encoded(spark, sf), P.LOGISTIC_BATCH)

    def weighted(values):
        return F.aggregate(F.transform(values, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    digest = weighted(F.transform("features", lambda row: weighted(row)))
    return out.select("batch_id", F.col("n_rows").cast("long").alias("n_rows"), _r(digest).alias("features"), _ints("labels").alias("labels"),
                      F.array_join(F.transform("label_lists", lambda r: F.array_join(F.transform(r, lambda x: x.cast("string")), ",")), "|").alias("label_lists"))


def train_test_split(spark, sf):
    return B.train_test_split(_t(spark, sf, "documents").select("doc_id"))


def predict(spark, sf):
    vecs = _doc_vectors(spark, sf)
    return LN.predict(vecs, FX.class_weights(spark, sf)).select("doc_id", F.col("pred").cast("long").alias("pred"))


def evaluate_model(spark, sf):
    scored = LN.predict(_doc_vectors(spark, sf), FX.class_weights(spark, sf))
    joined = V.attach_label_list(scored.select("doc_id", "pred"), _encoded(spark, sf))
    ev = E.evaluate_pairs(joined)
    return ev.select(_r("pair_error").alias("pair_error"), _r("doc_error").alias("doc_error"),
                     "n_pairs", "n_docs")


def vectorizer_plugin(spark, sf):
    from ..operators import ml as ML
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    tokens = TX.tokens_long(V.by_document(docs), stop_words=P.ENGLISH_STOP_WORDS)
    feats = ML.vectorize(tokens, ML.tfidf_plugin(docs))
    return feats.select("doc_id", "word", F.col("tf").cast("long").alias("tf"), _r("tfidf").alias("tfidf"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import flow as FL
    from . import ml_queries as MQ
    q = {
        "scan_dump_xml": scan_dump_xml, "scan_id_list": scan_id_list,
        "scan_doc_lines": scan_doc_lines, "scan_documents": scan_documents,
        "scan_category_tables": scan_category_tables, "load_artifacts": load_artifacts,
        "write_id_list": write_id_list, "write_documents": write_documents,
        "write_artifacts": write_artifacts, "write_metrics": write_metrics,
        "doc_id_from_path": doc_id_from_path, "path_from_doc_id": path_from_doc_id,
        "get_doc_by_id": get_doc_by_id, "get_vector_by_id": get_vector_by_id, "take_vector_page": take_vector_page, "edge_kind_filter": edge_kind_filter,
        "page_level_id": page_level_id, "drop_incomplete_pages": drop_incomplete_pages,
        "drop_blank_lines": drop_blank_lines, "remove_stopwords": remove_stopwords,
        "semi_join_ids": semi_join_ids, "resolve_titles": resolve_titles,
        "category_members": category_members, "labels_by_id": labels_by_id,
        "encode_labels": encode_labels, "lookup_word_vectors": lookup_word_vectors,
        "attach_label_list": attach_label_list, "category_descent": category_descent, "category_descent_partial": category_descent_partial,
        "label_dictionary": label_dictionary, "count_labels": count_labels,
        "total_words": total_words, "label_list_stats": label_list_stats,
        "corpus_counts": corpus_counts, "build_vocabulary": build_vocabulary,
        "clean_corpus_vocabulary": clean_corpus_vocabulary,
        "lemma_corpus_vocabulary": lemma_corpus_vocabulary,
        "mean_embedding": mean_embedding, "reduce_mean": reduce_mean,
        "weight_norms": weight_norms, "best_checkpoint": best_checkpoint,
        "best_iteration": best_iteration, "argmax_class": argmax_class,
        "take_batch": take_batch, "union_distinct_pages": union_distinct_pages,
        "distinct_ids": distinct_ids, "strip_numeric_brackets": strip_numeric_brackets,
        "strip_category_prefix": strip_category_prefix, "clean_document": clean_document,
        "tokenize": tokenize, "lemmatize_nouns": lemmatize_nouns,
        "markup_to_plain": markup_to_plain, "compose_document": compose_document,
        "decode_bytes": decode_bytes, "pad_label_list": pad_label_list,
        "dense_layer": dense_layer, "zero_one_multilabel_error": zero_one_multilabel_error,
        "softmax": softmax, "mean_nll": mean_nll, "conv_pool_1d": conv_pool_1d,
        "batch_count": batch_count, "explode_pairs": explode_pairs,
        "assign_batches": assign_batches, "assemble_batches": assemble_batches, "train_test_split": train_test_split,
        "predict": predict, "evaluate_model": evaluate_model,
        "vectorizer_plugin": vectorizer_plugin,
    }
    q.update(MQ.registry())
    q.update(FL.registry())
    return q
