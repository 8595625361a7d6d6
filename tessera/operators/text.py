"""Document-level text operators: cleaning, tokens in long form, stop words, lemmas."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def clean_documents(docs: DataFrame, text_col: str = "text", out_col: str = "text") -> DataFrame:
    return docs.withColumn(out_col, T.clean_document(text_col))


def token_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                stop_words=None, out_col: str = "tokens") -> DataFrame:
    """``(doc_id, tokens ARRAY)``; stop words dropped when a list is given."""
    toks = T.tokenize(text_col)
    if stop_words is not None:
        toks = T.remove_stopwords(toks, stop_words)
    return docs.select(id_col, toks.alias(out_col))


def tokens_long(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                stop_words=None) -> DataFrame:
    """``(doc_id, pos, word)``: one row per token, ``pos`` in document order.

    The long form is what the counting, lookup and lemma joins consume; it
    never regroups a document unless a list is asked for.
    """
    out = docs.select(id_col, F.posexplode(T.tokenize(text_col)).alias("pos", "word"))
    if stop_words is not None:
        out = remove_stopwords_long(out, stop_words)
    return out


def remove_stopwords_long(tokens: DataFrame, stop_words=None, word_col: str = "word") -> DataFrame:
    stop = list(P.ENGLISH_STOP_WORDS if stop_words is None else stop_words)
    return tokens.filter(~F.col(word_col).isin(stop))


def regroup_tokens(tokens: DataFrame, id_col: str = "doc_id", word_col: str = "word",
                   out_col: str = "tokens") -> DataFrame:
    """Long form back to ordered lists (one document per group)."""
    return (tokens.groupBy(id_col)
                  .agg(F.array_sort(F.collect_list(F.struct("pos", word_col))).alias("_s"))
                  .select(id_col, F.transform("_s", lambda s: s[word_col]).alias(out_col)))


def total_words(tokens: DataFrame) -> DataFrame:
    """Number of tokens (after whatever filtering produced ``tokens``)."""
    return tokens.agg(F.count(F.lit(1)).cast("long").alias("total_words"))


def noun_lemma_map(words: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None,
                   word_col: str = "word", distinct: bool = False) -> DataFrame:
    """``(word, lemma)`` for each distinct word, by suffix rules + lexicon.

    Candidates are the word itself and every suffix-rule rewrite; those in
    the lexicon survive and the shortest wins (ties: the word itself, then
    rule order). An exception table ``(word, lemma)`` overrides. Words with
    no surviving candidate map to themselves. Work is per distinct word, so
    the token stream is touched only by the final join. With ``distinct`` both
    inputs are known to hold a word once, nothing is made distinct again, and
    further columns of ``words`` (such as counts) are carried through.
    """
    w = F.col(word_col)
    cands = [F.struct(F.lit(0).alias("rule"), w.alias("cand"))]
    for i, (suf, rep) in enumerate(P.NOUN_SUFFIX_RULES, start=1):
        stem = F.expr(f"substring({word_col}, 1, length({word_col}) - {len(suf)})")
        cands.append(F.when(w.endswith(suf), F.struct(F.lit(i).alias("rule"),
                                                      F.concat(stem, F.lit(rep)).alias("cand"))))
    rows = words if distinct else words.select(word_col).distinct()
    carried = [c for c in rows.columns if c != word_col]
    # the word itself is always a candidate: whether or not the lexicon holds it, it is the
    # last resort, so one left join and one aggregate give every word its lemma
    ex = (rows.select(word_col, *carried, F.explode(F.filter(F.array(*cands), lambda c: c.isNotNull())).alias("c"))
              .select(word_col, *carried, "c.rule", "c.cand")
              .filter((F.length("cand") > 0) | (F.col("rule") == 0)))
    lex = lexicon.select(F.col(word_col if word_col in lexicon.columns else lexicon.columns[0]).alias("cand"))
    lex = (lex if distinct else lex.distinct()).withColumn("_known", F.lit(True))
    hits = ex.join(lex, "cand", "left")
    key = F.struct(F.length("cand"), F.col("rule"))
    out = hits.groupBy(word_col).agg(*[F.first(c).alias(c) for c in carried],
                                     F.min_by(F.when(F.col("_known"), F.col("cand")), F.when(F.col("_known") & (F.length("cand") > 0), key)).alias("lemma"))
    if exceptions is not None:
        exc = exceptions.select(F.col(exceptions.columns[0]).alias(word_col),
                                F.col(exceptions.columns[1]).alias("_exc")).dropDuplicates([word_col])
        out = out.join(exc, word_col, "left").withColumn("lemma", F.coalesce("_exc", "lemma")).drop("_exc")
    return out.select(word_col, *carried, F.coalesce("lemma", word_col).alias("lemma"))


def changed_lemmas(words: DataFrame, lexicon: DataFrame, word_col: str = "word") -> DataFrame:
    """``(word, lemma)`` of the words whose lemma is another word; both inputs hold a
    word once. A word without a rule's suffix has no other candidate and is left out first."""
    w = F.col(word_col)
    suffixed = words.where(reduce(or_, [w.endswith(suf) for suf, _ in P.NOUN_SUFFIX_RULES]))
    return noun_lemma_map(suffixed, lexicon, word_col=word_col, distinct=True).where(F.col("lemma") != w)


def lemmatize_long(tokens: DataFrame, lemma_map: DataFrame, word_col: str = "word") -> DataFrame:
    """Replace each token by its lemma; the map is per distinct word, and a word that it
    lacks stays as it is."""
    return (tokens.join(lemma_map, word_col, "left")
                  .withColumn(word_col, F.coalesce("lemma", word_col)).drop("lemma"))
