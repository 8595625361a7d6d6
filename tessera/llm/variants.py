"""Spelling variants: distinct words one code point apart, by variable-length grams.

Grams of two code points that many words share are extended while they stay
frequent; what is left is the gram dictionary. A word is cut into the longest grams
it starts with at each place (those inside another are left out), and the most of
them that one edit can change is its bound. Two near words share all grams but that
many, so of each word only the bound + 1 rarest grams need lists. A list holds the
words with a gram at a place that also agree in what an edit outside the gram leaves
whole: the other side, and one half of the side it falls on. Members are verified.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import materialize

RUN = "[A-Za-z\\u00C0-\\u00FF]"
MIN_POINTS = 7
MIN_COUNT = 2
DELETE_EVERY = 31
FORM_RATIO = 10
QMIN, QMAX = 2, 3  # one edit changes few grams this short, so few lists are needed
EXTEND_OVER = 20  # grams of more words than this are extended by a code point
WORDS_PER_TASK = 25_000  # cut into grams by one task, a few seconds of work
MAX_GRAMS = 100_000  # the dictionary is broadcast: the commonest grams, some megabytes at most
FIRST, LAST = "^", "$"  # end marks; no word holds them
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# -- words -----------------------------------------------------------------------

def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", delete_every: int = DELETE_EVERY,
                min_points: int = MIN_POINTS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z in lower case, with a code point
    taken out of every run whose crc32 of ``<id>:<run>`` is divisible by ``delete_every``
    (place: the remainder by its length); distinct results with their occurrences.

    A null text has no words, a null id reads as the empty text before the colon.
    A frequent word is added up by each task before the shuffle.
    """
    # a run of fewer code points can never give a word, so it is not even cut out
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(f"{RUN}{{{min_points},}}"), F.lit(0))).alias("run"))
    low = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % delete_every == 0, less).otherwise(F.col("run")).alias("word"))
    return (words.where(F.length("word") >= min_points).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


# -- the gram dictionary ------------------------------------------------------------

def gram_dictionary(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX, extend_over: int = EXTEND_OVER,
                    max_grams: int = MAX_GRAMS) -> dict[str, int]:
    """Gram -> number of places in the distinct words, with end marks. Holds grams of
    ``qmin`` and every longer one whose beginning is in more than ``extend_over`` places,
    of these the commonest ``max_grams`` at most; any such dictionary finds all pairs."""
    s = F.concat(F.lit(FIRST), F.col("word"), F.lit(LAST))
    grams = F.flatten(F.transform(F.sequence(F.lit(qmin), F.lit(qmax)), lambda q: F.transform(
        F.sequence(F.lit(1), F.length("s") - q + 1), lambda i: F.substring(F.col("s"), i, q))))
    counts = materialize(words.select(s.alias("s")).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")),
                         "variants-grams")
    level = F.floor(F.log2("n") * 8).cast("int")
    held, least = 0, 0
    for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():
        held, least = held + r["n"], r["level"]
        if held > max_grams:
            least += 1
            break
    found = {r["gram"]: int(r["n"]) for r in counts.where(level >= least).collect()}
    return {g: n for g, n in found.items() if len(g) == qmin or found[g[:-1]] > extend_over}


class GramIndex:
    """Cuts words into grams of a dictionary and gives the keys of their lists."""

    def __init__(self, grams: dict[str, int], qmin: int = QMIN, qmax: int = QMAX):
        self.grams, self.qmin, self.qmax = grams, qmin, qmax
        self.starts = {g[:n] for g in grams for n in range(qmin, len(g))}  # beginnings that a gram goes on from
        self.ends = {g[n:] for g in grams for n in range(1, len(g) - qmin + 1)}  # ends that a gram leads up to

    def cut(self, s: str) -> list[tuple[int, int]]:
        """First and last place of the grams of ``s``."""
        out, last = [], -1
        for p in range(len(s) - self.qmin + 1):
            n = next((k for k in range(min(self.qmax, len(s) - p), self.qmin, -1) if s[p:p + k] in self.grams), self.qmin)
            if p + n - 1 > last:
                last = p + n - 1
                out.append((p, last))
        return out

    def bound(self, s: str, cut: list[tuple[int, int]]) -> int:
        """The most grams of ``s`` that one edit between its end marks can change.

        An edit at place i changes the grams over it. To its left, a gram that starts
        no earlier than some text that could now go on into a longer gram may be lost
        in that one; to its right, a gram that ends no later than some text a longer
        gram could now lead up to.
        """
        m, q = len(s), self.qmax
        starts, ends = [a for a, _ in cut], [b for _, b in cut]
        left = [min((p for p in range(max(0, i - q + 1), i - self.qmin + 1) if s[p:i] in self.starts), default=m) for i in range(m)]
        right = [max((e for e in range(i + self.qmin - 1, min(m, i + q - 1)) if s[i:e + 1] in self.ends), default=-1) for i in range(m)]
        most = 0
        for i in range(1, m):
            # grams are in order of both ends: those changed are one stretch of the list
            before = min(bisect_left(ends, i), bisect_left(starts, left[i]))
            if i < m - 1:  # place i replaced or deleted
                after = max(bisect_left(starts, i + 1), bisect_left(ends, right[i + 1] + 1))
                most = max(most, after - before)
            after = max(bisect_left(starts, i), bisect_left(ends, right[i] + 1))  # something inserted before place i
            most = max(most, after - before)
        return most

    def keys(self, word: str) -> tuple[list[str], list[str]]:
        """Keys of the lists the word stands in, as one of equal length or the shorter
        word, and as the longer one. Near words meet in one list at least."""
        s = FIRST + word + LAST
        cut = self.cut(s)
        shared = len(cut) - self.bound(s, cut)
        rarest = sorted((self.grams.get(s[a:b + 1], 0), s[a:b + 1], a, b) for a, b in cut)[:len(cut) - max(shared, 1) + 1]
        places = [(a, b) for _, _, a, b in rarest]
        if shared < 1:  # nothing but the end mark is sure to stay: words like this meet there
            places.append((0, 0))
        return sorted(self._lists(s, places, 0)), sorted(self._lists(s, places, 1))

    @staticmethod
    def _lists(s: str, places: list[tuple[int, int]], longer: int) -> set[str]:
        m, out = len(s), set()
        size = m - longer  # length of the shorter word's text: it names the list
        for a, b in places:
            rest = size - b - 1
            if rest > 0:  # the edit falls to the right of the gram
                half = rest // 2
                if half:
                    out.add(f"{size}<{s[:b + 1 + half]}")
                out.add(f"{size}|{s[:b + 1]}|{s[m - (rest - half):]}")
            rest = a - longer
            if rest > 0:  # to its left
                half = rest // 2
                if rest > 1:
                    out.add(f"{size}>{s[a - (rest - half):]}")
                out.add(f"{size}|{s[:half]}|{s[a:]}")
        return out


# -- near words -------------------------------------------------------------------------

def near_words(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX, extend_over: int = EXTEND_OVER) -> DataFrame:
    """words(word), each word once -> (word, other): all pairs that differ by exactly
    one inserted, deleted or replaced code point, each once with the shorter (of equal
    length the lesser) word first. Words hold neither end mark."""
    tasks = max(1, -(-words.count() // WORDS_PER_TASK))
    index = words.sparkSession.sparkContext.broadcast(gram_dictionary(words, qmin, qmax, extend_over))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = GramIndex(index.value, qmin, qmax)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys = [own.keys(w) for w in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([k[0] for k in keys], pa.list_(pa.string())),
                                                  pa.array([k[1] for k in keys], pa.list_(pa.string()))], names=["word", "short", "long"])

    cut = materialize(words.select("word").repartition(tasks, "word").mapInArrow(listed, "word string, short array<string>, long array<string>"),
                      "variants-lists")

    def lists(of: str) -> DataFrame:
        return cut.select(F.explode(of).alias("key"), "word").select(F.xxhash64("key").alias("key"), "word")

    def met(other: DataFrame, more) -> DataFrame:
        # equal plans on both sides, so the lists of equal or shorter words are shuffled once for all
        pairs = lists("short").alias("a").join(other.alias("b"), F.col("a.key") == F.col("b.key"))
        close = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
        return pairs.where(close & more).select(F.col("a.word").alias("word"), F.col("b.word").alias("other"))
    equal = met(lists("short"), F.col("a.word") < F.col("b.word"))
    return equal.unionAll(met(lists("long"), F.lit(True))).distinct()


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of :func:`count_words`.

    n_near counts the near words; form is the near word of largest n (of equals the
    least in code-point order) if that is at least ``FORM_RATIO`` times the word's own
    n; root is the end of the chain of forms. Null texts and empty tables give no
    words; repeated rows count each time; other columns are not read.
    """
    words = materialize(count_words(docs, id_col, text_col), "variants-words")
    pairs = materialize(near_words(words), "variants-pairs")
    both = pairs.unionAll(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))
    counted = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = F.min(F.struct(F.negative("other_n").alias("less"), F.col("other")))
    near = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")).join(words, "word")
    formed = F.negative("best.less") >= F.lit(FORM_RATIO) * F.col("n")
    near = materialize(near.select("word", "n_near", F.when(formed, F.col("best.other")).alias("form"),
                                   F.when(formed, F.negative("best.less")).alias("form_n")), "variants-near")
    roots = near.where("form is not null").select("word", F.col("form").alias("root"))
    # each round doubles the steps followed; a form has ten times the count, so chains are short
    while True:
        moved = Observation(f"variants-{id(roots)}")
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went"))
        roots = materialize(step.observe(moved, F.count(F.when(F.col("went"), 1)).alias("n")), "variants-roots").select("word", "root")
        if not moved.get.get("n"):
            break
    return (words.join(near, "word", "left").join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n"))
