"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are long mixed tokens, tokens of a published key format, values given
to names such as ``password`` and the user-info of URLs.
Their features are length, character transitions, dictionary coverage, the path
they stand in and the words beside them. A random forest is trained on labelled
findings: tokens of a published key format, random-looking values given to such a
name (in a URL's query, too) or standing in a URL's user-info are secrets; plain
numbers, UUIDs, identifiers made of words, URL paths, mail addresses, placeholders
and words are not, wherever they stand. Only whole tokens of a published format, and
private key blocks, are secrets at any score; all others are decided by the forest.

Every pattern enters a stretch of text a bounded number of times, so a text without
white space takes time in proportion to its length, too.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..session import materialize
from .common import packed

SAMPLE_FINDINGS = 4000  # most labelled findings of each class that are fitted on
DICTIONARY = 5000  # most common words of all texts, which bounds what reaches the driver
TREES, DEPTH, MIN_LEAF, CUTS = 30, 8, 3, 16
THRESHOLD = 0.5
MASK = "[SECRET]"

_NAMES = r"pass(?:word|wd|phrase)?|pwd|secret|token|credential|api[_-]?key|access[_-]?key|private[_-]?key|auth"
_NAMED = re.compile(rf"""(?i)({_NAMES})["']?[ \t]*[=:][ \t]*["']?$""")
_NEAR = re.compile(rf"(?i)({_NAMES}|\bkey\b)")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{12,}={0,2}")
_GIVEN = re.compile(rf"""(?i)(?:{_NAMES})["']?[ \t]*[=:][ \t]*["']?""")
_VALUE_END = re.compile(r"""[\s"'<>,;]|$(?![\s\S])""")
_WORTH = re.compile(r"[0-9]|[=:][ \t]*[\"']?\S|[A-Za-z+/_\-]{16}|-----BEGIN ")
# what ends a named value: the next name=value pair, in a URL also its delimiters
_NEXT_PAIR = re.compile(r"&(?=[\w.\-]+=)")
_URL_PART = re.compile(r"[&#;@]")
_AUTHORITY_END = re.compile(r"[/?#]")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----")
_UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
# words with numbers and marks between them: build_2024_final_v3, chapter12intro
_IDENTIFIER = re.compile(r"(?:[_\-./:]?(?:[A-Za-z]++|[0-9]{1,4}+(?![0-9])))++")
_USER_INFO = re.compile(r"""://([^\s/?#:@"'<>]*)(?::([^\s/?#"'<>]+))?@(?=[\w\[])""")
_MAIL = re.compile(r"[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)*\.[A-Za-z]{2,}")
# published key formats
_FORMATS = re.compile(r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|"
                      r"xox[abpr]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}|"
                      r"github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|sk-proj-[A-Za-z0-9_-]{20,}|sk-ant-[A-Za-z0-9_-]{20,}|"
                      r"npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}|dop_v1_[a-f0-9]{64}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}")
_FORMATTED = re.compile(rf"(?<![A-Za-z0-9])(?:{_FORMATS.pattern})(?![A-Za-z0-9])")
_PLACEHOLDER = re.compile(r"(?i)example|sample|dummy|changeme|placeholder|your|x{4,}|12345678|abcdef12|(.)\1{5,}")
_WORDS = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[A-Za-z][a-z]{2,}(?:[A-Z][a-z]{2,})+)(?:[\-/_]+(?:[A-Z]?[a-z]+|[A-Z]+))*")
_CONSONANTS = re.compile(r"(?i)[bcdfghj-np-tvwxz]{6}")
_HARD = re.compile(r"(?i)[bcdfghj-np-tvwxz]{5}")
_NO_PASSWORD = re.compile(rf"(?i)(?:{_NAMES}|pass|pw|user(?:name)?|x-oauth-basic|x-access-token|oauth2?|[$%{{\[(].*|\*+|\.+)")
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "changes", "digits", "uppers", "entropy", "likelihood", "coverage", "hex", "path", "address",
            "named", "near", "quoted", "word_before", "word_after", "uuid", "readable")
_FINDING = "array<struct<start:int,n_chars:int,digest:string,label:int,certain:boolean,x:array<float>>>"
_WINDOW = 40  # characters beside a candidate that are looked at
_BARE, _BITS = 16, 3.5  # least characters and entropy a character of a bare token without a digit


class Language:
    """Common words, and letter transitions by their counts: pairs of "a" to "z"
    and "#" for any other character."""

    def __init__(self, words: list[str], transitions: dict[str, int]):
        self.words = frozenset(words)
        self.longest = min(20, max(map(len, words), default=0))
        pairs = np.ones((27, 27))
        for pair, n in transitions.items():
            pairs[tuple(self._codes(pair))] += n
        self.logp = np.log(pairs / pairs.sum(axis=1, keepdims=True))

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.array([_LETTERS.find(c) % 27 for c in text.lower()], np.int64)

    def likelihood(self, text: str) -> float:
        codes = self._codes(text)
        return float(self.logp[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0

    def coverage(self, text: str) -> float:
        """Share of the characters in dictionary words, longest first."""
        low, at, covered = text.lower(), 0, 0
        while at < len(low):
            for k in range(min(self.longest, len(low) - at), 2, -1):
                if low[at:at + k] in self.words:
                    covered += k
                    at += k
                    break
            else:
                at += 1
        return covered / max(1, len(low))


def entropy(s: str) -> float:
    return -sum(c / len(s) * np.log2(c / len(s)) for c in Counter(s).values())


def mixed(s: str) -> bool:
    """Letters of both cases with capitals inside, of high entropy."""
    return len(s) >= _BARE and bool(re.search(r"[a-z][A-Z]", s)) and entropy(s) >= _BITS


class Urls:
    """The URLs of a text: for each "://" where its stretch without white space and
    its host part end. A text is gone through once."""

    def __init__(self, text: str):
        self.starts, self.ends, self.hosts = [], [], []
        if "://" not in text:
            return
        for run in re.finditer(r"\S+", text):
            at = text.find("://", run.start(), run.end())
            while at >= 0:
                beyond = text.find("://", at + 3, run.end())
                # a host part ends before the next "://", whose slash ends it at the latest
                stop = _AUTHORITY_END.search(text, at + 3, run.end() if beyond < 0 else beyond + 2)
                self.starts.append(at)
                self.ends.append(run.end())
                self.hosts.append(stop.start() if stop else run.end())
                at = beyond

    def over(self, a: int) -> int:
        """Number of the last "://" that ends before place ``a`` in its stretch; -1 if none."""
        i = bisect_left(self.starts, a - 2) - 1
        return i if i >= 0 and a <= self.ends[i] else -1


def spans(text: str, urls: Urls | None = None) -> list[tuple[int, int]]:
    """Candidate spans in text order; none overlap. Private key blocks go first, then
    user-info of URLs before named values, these before tokens of key formats, and
    these before bare tokens."""
    if not _WORTH.search(text):
        return []
    urls = urls or Urls(text)
    taken: list[tuple[int, int]] = []

    def take(found) -> None:
        """Adds, in text order, what overlaps nothing taken before."""
        nonlocal taken
        old, new, end = taken, [], -1
        for a, b in found:
            i = bisect_left(old, (a, b))
            if a >= end and not (i and old[i - 1][1] > a) and not (i < len(old) and old[i][0] < b):
                new.append((a, b))
                end = b
        taken = sorted(old + new)

    if "-----BEGIN " in text:
        take(_key_blocks(text))
    if urls.starts:
        take(m.span(g) for m in _USER_INFO.finditer(text) for g in (1, 2)
             if g == 2 and m[2] or g == 1 and len(m[1]) >= 12 and (re.search(r"[0-9]", m[1]) or mixed(m[1])))
    if "=" in text or ":" in text:
        take(_named_values(text, urls))
    take(m.span() for m in _FORMATTED.finditer(text))
    bare = []
    for m in _CANDIDATE.finditer(text):
        i, at = bisect_left(taken, m.span()), m.start()
        cuts = taken[max(0, i - 1):bisect_left(taken, (m.end(), 0))]
        for a, b in [*cuts, (m.end(), m.end())]:
            part = text[at:max(at, a)]
            if len(part) >= 12 and (re.search(r"[0-9]", part) or len(part) >= _BARE and entropy(part) >= _BITS):
                bare.append((at, a))
            at = max(at, b)
    take(bare)
    return taken


def _key_blocks(text: str):
    """From the header to the footer of private keys; one without a footer ends with
    its last line of key characters."""
    at = 0
    while m := _PEM.search(text, at):
        foot = f"-----END {m[1]}-----"
        body = re.compile(r"[A-Za-z0-9+/=\s:,.\-]*").match(text, m.end()).end()
        end = text.find(foot, m.end(), body + len(foot))
        at = end + len(foot) if end >= 0 else max(m.end(), m.end() + len(text[m.end():body].rstrip()))
        yield m.start(), at


def _named_values(text: str, urls: Urls):
    at = end = 0
    while m := _GIVEN.search(text, at):
        a = m.end()
        if a >= end:  # the stretch is searched to its end once
            end = _VALUE_END.search(text, a).start()
        here = urls.over(min(end, a + 1))
        inner = text.find("://", a, min(end, a + 12))  # a scheme has few letters
        if inner >= 0 and not _NEXT_PAIR.search(text, a, inner):
            at = a  # the value is a URL, whose parts are looked at
            continue
        b = end
        if here >= 0 and urls.starts[here] + 3 <= a:
            part = _URL_PART.search(text, a, b)
            b = part.start() if part else b
        pair = _NEXT_PAIR.search(text, a, b)
        b = pair.start() if pair else b
        if b - a >= 6:
            yield a, b
        at = max(b, a)


def place(text: str, a: int, b: int, urls: Urls | None = None) -> str:
    """"user-info" or "named" for what stands where secrets are given, "address"
    for parts of URLs and mail addresses, else ""."""
    urls = urls or Urls(text)
    s, before = text[a:b], text[max(0, a - _WINDOW):a]
    i = urls.over(a)
    if i >= 0 and urls.hosts[i] >= a and s[:1] != "/":
        if text[b:b + 1] == "@":  # a password, or a user without one
            return "user-info"
        if a == urls.starts[i] + 3 and text[b:b + 1] == ":" and text.find("@", b, urls.hosts[i]) >= 0:
            return ""  # a user with a password
    if _NAMED.search(before):
        return "named"
    left, right = re.search(r"\S*$", before)[0], re.match(r"\S*", text[b:b + _WINDOW])[0]
    return "address" if i >= 0 or "@" in left + right else ""


def features(text: str, a: int, b: int, language: Language, urls: Urls | None = None) -> list[float]:
    s = text[a:b]
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "o" for c in s]
    n = len(s)
    before, after = text[max(0, a - _WINDOW):a], text[b:b + _WINDOW]
    left = re.search(r"\S*$", before)[0]
    right = re.match(r"\S*", after)[0]
    where = place(text, a, b, urls)
    given = where in ("user-info", "named")
    near = re.findall(r"[^\W\d_]+", before.lower())[-1:] + [""]
    beyond = re.findall(r"[^\W\d_]+", after.lower())[:1] + [""]
    return [np.log(n), sum(x != y for x, y in zip(kinds, kinds[1:])) / max(1, n - 1), kinds.count("d") / n, kinds.count("u") / n,
            entropy(s), language.likelihood(s), language.coverage(s),
            float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s))), float("/" in left + right or "\\" in left + right),
            float(not given and not _FORMATS.fullmatch(s) and (where == "address" or "." in left[-1:] or "www." in left)),
            float(given), float(bool(_NEAR.search(before))), float(before[-1:] in "\"'`" and before != ""),
            float(near[0] in language.words), float(beyond[0] in language.words),
            float(bool(_UUID.fullmatch(s))), float(readable(s))]


def readable(s: str) -> bool:
    """An identifier of words: all letter runs but one are long, with vowels and few
    consonants in a row, and its numbers are short. Hex digits alone are none."""
    if not _IDENTIFIER.fullmatch(s) or re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return False
    runs = re.findall(r"[A-Z]?[a-z]+|[A-Z]+", s)
    long = [r for r in runs if len(r) >= 3]
    return bool(long) and len(runs) - len(long) <= 1 and all(re.search(r"(?i)[aeiouy]", r) and not _HARD.search(r) for r in long)


def certain(text: str, a: int, b: int) -> bool:
    """A private key block, or a whole token of a published format, no placeholder."""
    s = text[a:b]
    return s.startswith("-----BEGIN ") or bool(_FORMATS.fullmatch(s)) and not _PLACEHOLDER.search(s)


def known_label(text: str, a: int, b: int, urls: Urls | None = None) -> int | None:
    """1 or 0 where the finding's nature is known from its format, or from its place
    and look together."""
    if certain(text, a, b):
        return 1
    s = text[a:b]
    where = place(text, a, b, urls)
    if _PLACEHOLDER.search(s) or where != "user-info" and re.fullmatch(r"[\d\-+/ ]+", s):
        return 0
    if _UUID.fullmatch(s) or where != "user-info" and readable(s):
        return 0
    odd = re.search(r"\d", s) and re.search(r"[A-Za-z]", s) and len(set(s)) >= 6 or mixed(s)
    if where == "user-info":
        if _NO_PASSWORD.fullmatch(s):
            return 0
        return 1 if text[a - 1] == ":" or odd else None
    if where == "named":
        return 1 if odd and not _MAIL.fullmatch(s) else None
    if where == "address":
        return 0
    # words and joined words are none, long compounds of one case neither; other bare
    # tokens are left to the forest
    compound = re.fullmatch(r"[A-Z]?[a-z]+", s) and 4 * len(re.findall(r"[aeiouy]", s.lower())) >= len(s)
    return 0 if compound or _WORDS.fullmatch(s) and not _CONSONANTS.search(s) else None


class Forest:
    """Random forest of binary trees over float rows, classes 0 and 1."""

    def __init__(self, trees: list[list[tuple]]):
        self.trees = trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        if not len(y) or y.min() == y.max():
            return cls([[(-1, 0.0, 0, 0, float(y[0]) if len(y) else 0.0)]])
        weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
        return cls([cls._tree(x[i], y[i], weight[i], rng) for i in (rng.integers(0, len(y), len(y)) for _ in range(TREES))])

    @staticmethod
    def _tree(x, y, w, rng) -> list[tuple]:
        nodes: list[tuple] = []

        def grow(rows, depth):
            me = len(nodes)
            nodes.append(())
            total, ones = w[rows].sum(), (w[rows] * y[rows]).sum()
            leaf = (-1, 0.0, 0, 0, float((ones + 0.5) / (total + 1)))
            best = None
            if depth < DEPTH and len(rows) >= 2 * MIN_LEAF and 0 < ones < total:
                for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5) + 1), replace=False):
                    column = x[rows, f]
                    for cut in np.unique(np.quantile(column, np.linspace(0, 1, CUTS + 2)[1:-1])):
                        low = column <= cut
                        if MIN_LEAF <= low.sum() <= len(rows) - MIN_LEAF:
                            a, a1 = w[rows][low].sum(), (w[rows] * y[rows])[low].sum()
                            b, b1 = total - a, ones - a1
                            impurity = 2 * a1 * (1 - a1 / a) + 2 * b1 * (1 - b1 / b)
                            if best is None or impurity < best[0] - 1e-12:
                                best = (impurity, int(f), float(cut), low)
            if best is None or best[0] >= 2 * ones * (1 - ones / total) - 1e-9:
                nodes[me] = leaf
            else:
                _, f, cut, low = best
                left = grow(rows[low], depth + 1)
                right = grow(rows[~low], depth + 1)
                nodes[me] = (f, cut, left, right, leaf[4])
            return me

        grow(np.arange(len(y)), 0)
        return nodes

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean probability of class 1 over the trees."""
        total = np.zeros(len(x))
        for tree in self.trees:
            f, cut, left, right, value = (np.array(c) for c in zip(*tree))
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                inner = f[at] >= 0
                go = np.where(x[np.arange(len(x)), np.maximum(f[at], 0)] <= cut[at], left[at], right[at])
                at = np.where(inner, go, at)
            total += value[at]
        return total / max(1, len(self.trees))


def learn_language(docs: DataFrame) -> Language:
    """From the counts of all words of all whole texts, repeated rows included.
    The letter pairs are summed from these counts; their number is bounded."""
    text = F.lower(F.col("text").cast("string"))
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit(r"\p{L}{3,}"), F.lit(0))).alias("word"))
    counts = materialize(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "secret-words")
    common = counts.orderBy(F.desc("n"), "word").limit(DICTIONARY).collect()
    plain = F.regexp_replace("word", "[^a-z]", "#")
    pairs = F.transform(F.sequence(F.lit(1), F.length(plain) - 1), lambda i: F.substring(plain, i, F.lit(2)))
    sums = counts.select("n", F.explode(pairs).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return Language([r.word for r in common], {r.pair: r.n for r in sums})


def candidates(docs: DataFrame, language: Language) -> DataFrame:
    """documents -> doc_id, start, n_chars, digest, label, certain, x: every candidate
    of every whole text, with its features, and its label where that is known.
    Positions are code points from 0; digest is the SHA-256 of the candidate."""
    @arrow_udf(_FINDING)
    def found(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            urls = Urls(text or "")
            out.append([{"start": a, "n_chars": b - a, "digest": hashlib.sha256(text[a:b].encode()).hexdigest(), "label": known_label(text, a, b, urls),
                         "certain": certain(text, a, b), "x": features(text, a, b, language, urls)} for a, b in spans(text or "", urls)])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("n_chars", pa.int32()), ("digest", pa.string()), ("label", pa.int32()),
                                   ("certain", pa.bool_()), ("x", pa.list_(pa.float32()))]))
        return pa.array(out, kind)
    return docs.select("doc_id", F.explode(found(F.col("text").cast("string"))).alias("f")).select("doc_id", "f.*")


def train(findings: DataFrame) -> Forest:
    """A forest from the labelled findings; of each class the first
    ``SAMPLE_FINDINGS`` distinct ones by digest, which bounds what reaches the driver."""
    rows = []
    for label in (0, 1):
        some = findings.where(F.col("label") == label).groupBy("digest").agg(F.min("x").alias("x"))
        rows += [(label, r.x) for r in some.orderBy("digest").limit(SAMPLE_FINDINGS).collect()]
    x = np.array([r[1] for r in rows], np.float32).reshape(-1, len(FEATURES))
    return Forest.fit(x, np.array([r[0] for r in rows]))


def score_column(x: Column, forest: Forest) -> Column:
    @arrow_udf("double")
    def scored(rows: pa.Array) -> pa.Array:
        return pa.array(forest.score(rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))))
    return scored(x)


def scan_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents -> doc_id, start, n_chars, digest, score, is_secret: one row per
    candidate finding, false positives marked by ``is_secret`` false; ``score`` is
    the forest's; whole tokens of a published format and private key blocks are secrets
    at any score.

    Null and empty texts have no findings. Repeated rows give their findings
    again. Without labelled findings of both classes every finding gets the one
    class there is, or 0. An empty table gives an empty table."""
    found = materialize(candidates(docs, learn_language(docs)), "secret-findings")
    forest = train(found)
    return (found.select("doc_id", "start", "n_chars", "digest", score_column(F.col("x"), forest).alias("score"), "certain")
            .select("doc_id", "start", "n_chars", "digest", "score", (F.col("certain") | (F.col("score") >= threshold)).alias("is_secret")))


def mask_secrets(docs: DataFrame, threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """All rows of ``docs`` with the secrets in ``text`` replaced by ``mask``;
    ``n_chars``, where there is such a column, follows the new text. Other columns
    and texts without a secret are unchanged, null texts stay null, repeated rows are
    masked each, an empty table stays empty."""
    language = learn_language(docs)
    labelled = materialize(candidates(docs, language).where("label is not null").select("digest", "label", "x"), "secret-labelled")
    forest = train(labelled)

    @arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        whole = texts.to_pylist()
        urls = [Urls(t or "") for t in whole]
        places = [(i, a, b) for i, t in enumerate(whole) for a, b in spans(t or "", urls[i])]
        if places:
            scores = forest.score(np.array([features(whole[i], a, b, language, urls[i]) for i, a, b in places], np.float32))
            cuts: dict[int, list[tuple[int, int]]] = {}
            for (i, a, b), score in zip(places, scores):
                if score >= threshold or certain(whole[i], a, b):
                    cuts.setdefault(i, []).append((a, b))
            for i, found in cuts.items():  # a text is put together once
                t, ends = whole[i], [0, *(b for _, b in found)]
                whole[i] = mask.join(t[x:y] for x, y in zip(ends, [*(a for a, _ in found), len(t)]))
        return pa.array(whole, pa.string())

    rows = docs.select(packed(docs).alias("row"), masked(F.col("text").cast("string")).alias("masked"))
    cols = []
    for c in docs.columns:
        old = F.col("row").getField(c)
        if c == "text":
            cols.append(F.col("masked").alias(c))
        elif c == "n_chars":
            cols.append(F.when(F.col("masked") == F.col("row").getField("text"), old)
                        .otherwise(F.length("masked").cast(docs.schema[c].dataType)).alias(c))
        else:
            cols.append(old.alias(c))
    return rows.select(*cols)
