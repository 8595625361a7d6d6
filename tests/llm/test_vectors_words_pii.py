"""Whitening, personal data and spelling variants against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tessera.llm import pii, variants, whitening

from .helpers import awkward_docs, no_docs, prose

VECTORS = "vec_id bigint, embedding array<float>, n bigint, component int, whitened string"


# -- whitening -----------------------------------------------------------------

@pytest.mark.parametrize("kind", ["random", "equal", "clusters", "low rank", "one", "diagonal"])
def test_eigenvectors(kind):
    rng = np.random.default_rng(1)
    a = {"random": lambda: np.cov(rng.normal(size=(200, 40)).T), "equal": lambda: np.eye(20) * 3.0, "one": lambda: np.array([[2.0]]),
         "low rank": lambda: (lambda x: x @ x.T)(rng.normal(size=(30, 4))), "diagonal": lambda: np.diag([1.0, 5.0, 3.0, 5.0]),
         "clusters": lambda: (lambda q: q @ np.diag(np.r_[[5.0] * 8, [5 - 1e-9] * 4, [4.0] * 8, np.linspace(3, 1, 20)]) @ q.T)(
             np.linalg.qr(rng.normal(size=(40, 40)))[0])}[kind]()
    a = (a + a.T) / 2
    values, x = whitening.leading_components(a, 32)
    want = np.linalg.eigvalsh(a)[::-1]
    assert len(values) == (4 if kind == "low rank" else min(32, len(a)))
    assert np.allclose(values, want[:len(values)], rtol=1e-12, atol=1e-12 * want[0])
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-12
    assert np.abs(a @ x - x * values).max() < 1e-12 * want[0]


def _vectors(spark, n=300, dim=40):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(dim, dim)) / 4
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=dim) @ mix + 2]) for i in range(n)]
    rows += [rows[5], rows[5], (None, rows[7][1])]  # repeated rows, a null id
    bad = [(900, None), (901, [float("nan")] * dim), (902, [1.0] * (dim - 1) + [None]), (903, [float("inf")] + [1.0] * (dim - 1)),
           (904, [1.0, 2.0]), (905, [])]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows + bad], VECTORS)
    return df.repartition(5), rows


def test_whitening_against_eigh(spark):
    df, rows = _vectors(spark)
    out = whitening.whitened_rows(df).toPandas()
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    z = n * x - s
    y = z / n
    cov = y.T @ y / n
    values, u = np.linalg.eigh(cov)
    values, u = values[::-1][:32], u[:, ::-1][:, :32]
    want = y @ u / np.sqrt(values)
    assert len(out) == 32 * n and set(out.n) == {n} and set(out.component) == set(range(1, 33))
    mine = out[out.vec_id.notna()].drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened")
    at = [i for i, (v, _) in enumerate(rows[:300])]
    sign = np.sign((mine.loc[[rows[i][0] for i in at]].to_numpy() * want[at]).sum(axis=0))
    assert np.abs(mine.loc[[rows[i][0] for i in at]].to_numpy() * sign - want[at]).max() < 1e-9
    first = out[out.component == 1].set_index("vec_id")
    assert all(first.loc[rows[i][0], "deviation"].tolist() == int((z[i] ** 2).sum()) for i in at if i != 5)
    shares = out.drop_duplicates("component").set_index("component").explained
    assert np.allclose(shares.loc[range(1, 33)], values / np.trace(cov), rtol=1e-10)
    assert out.identity_error.nunique() == 1 and out.identity_error.iloc[0] < 1e-10
    assert (out.groupby("vec_id", dropna=False).size() == [32 * k for k in Counter([v for v, _ in rows]).values()][0]).sum() >= 1
    assert len(out[out.vec_id == 5]) == 3 * 32 and len(out[out.vec_id.isna()]) == 32


def test_whitening_without_variance(spark):
    none = spark.createDataFrame([], VECTORS)
    assert whitening.whitened_rows(none).count() == 0
    same = spark.createDataFrame([(i, [1.5, 2.5], 1, 1, "") for i in range(4)], VECTORS)
    assert whitening.whitened_rows(same).count() == 0
    assert whitening.whiten(same, whitening.fit_whitening(same)).select("deviation").distinct().collect()[0][0] == 0
    line = spark.createDataFrame([(i, [float(i), 1.0], 1, 1, "") for i in range(5)], VECTORS)
    out = whitening.whitened_rows(line).collect()
    assert len(out) == 5 and {r.component for r in out} == {1} and abs(out[0].explained - 1) < 1e-12


def test_deviation_beyond_int64():
    x = np.array([[1, 2], [1 << 61, 5]], np.int64)
    sums = [int(v) for v in x.astype(object).sum(axis=0)]
    z = whitening.spread_from_mean(x, 1000, sums)
    assert [int(v) for v in z[1]] == [1000 * (1 << 61) - sums[0], 5000 - 7]
    assert whitening.deviations(z)[1] == (1 << 63) - 1
    big = np.array([[1 << 31, 1 << 30], [3037000499, 0], [3037000500, 0]], np.int64)
    assert whitening.deviations(big) == [min((1 << 63) - 1, sum(int(v) ** 2 for v in r)) for r in big]


# -- personal data ---------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(s):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(int(c) for c in reversed(s))) % 10 == 0


def _base(text):
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for at, (kind, p, ok) in enumerate([
            ("email", EMAIL, lambda s: True), ("ip", IP, lambda s: all(int(x) <= 255 for x in s.split("."))),
            ("card", CARD, lambda s: 12 <= len(digits(s)) <= 19 and _luhn(digits(s))), ("phone", PHONE, lambda s: 9 <= len(digits(s)) <= 15)]):
        out += [(m.start(), at, m.end(), kind) for m in p.finditer(text) if ok(m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def _odd_text(rng, n):
    parts = ["a@b.c", "_d@e.fg", "@", ".", "1.2.3.4", "256.1.1.1", "007.08.9.255", "4111 1111-1111 1111", "4111111111111112", "+1 (555) 123-4567",
             "+", "12", " ", "-", "é", "🙂", "x", "\n", "000", "5-5 5", "GB82 WEST 1234 5698 7654 32", "(555) 123-4567", "123-45-6789", "call"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_pii_base_spans_against_finditer(spark):
    rng = random.Random(4)
    docs = awkward_docs(spark, [(1000 + i, _odd_text(rng, rng.randint(1, 60)), "s") for i in range(400)])
    out = pii.pii_digests(docs).collect()
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    assert len(out) == docs.count()
    for r in out:
        wants = [_base(t) for t in texts[r.doc_id]]
        want = next((w for w in wants if hashlib.sha256(w.encode()).hexdigest() == r.base_sha256), None)
        assert want is not None, (texts[r.doc_id], r)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k + ":") for k in pii.BASE_KINDS]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    assert pii.pii_digests(no_docs(spark)).count() == 0


def _found(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    return [(f.kind, f.text, round(f.score, 2)) for f in pii.find_pii(docs).collect()[0].findings]


def test_pii_added_kinds_need_checksum_and_context(spark):
    assert _found(spark, "pay to IBAN GB82 WEST 1234 5698 7654 32 PLEASE") == [("iban", "GB82 WEST 1234 5698 7654 32", 0.95)]
    assert _found(spark, "code DE89370400440532013000.") == [("iban", "DE89370400440532013000", 0.8)]
    assert _found(spark, "iban GB82 WEST 1234 5698 7654 33, DE8937040044053201300, XX82WEST12345698765432, aGB82WEST12345698765432") == []
    assert _found(spark, "his SSN: 123-45-6789") == [("ssn", "123-45-6789", 0.8)]
    assert _found(spark, "part 123-45-6789 only") == []
    assert _found(spark, "ssn 666-45-6789, 000-12-3456, 123-00-3456, 123-45-0000, 1123-45-67890") == []
    assert _found(spark, "call 555-123-4567 now") == [("tel", "555-123-4567", 0.7)]
    assert _found(spark, "between 555-123-4567 and 5") == []
    assert _found(spark, "phone +1 (555) 123-4567") == [("phone", "+1 (555) 123-4567", 0.9)]
    low, high = _found(spark, "release 1.2.3.4 of")[0], _found(spark, "login from 1.2.3.4 of")[0]
    assert low[:2] == high[:2] == ("ip", "1.2.3.4") and low[2] < high[2]


def test_mod97_and_running_sums(spark):
    from pyspark.sql import functions as F
    rng = random.Random(9)
    codes = ["".join(rng.choice("ABCXYZ0123456789") for _ in range(rng.randint(5, 34))) for _ in range(50)]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    for r in df.select("c", pii.mod97(F.col("c")).alias("m")).collect():
        assert r.m == int("".join(str(int(x, 36)) for x in r.c[4:] + r.c[:4])) % 97
    lists = [[], [5], list(range(10)), [rng.randint(0, 9) for _ in range(1003)]]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<int>").select("i", pii.running_sums(F.col("v")).alias("s")).collect()
    assert {r.i: list(r.s) for r in got} == {i: np.cumsum(v).astype(int).tolist() for i, v in enumerate(lists)}


def test_pii_time_is_in_proportion(spark):
    took = time.time()
    for part in ("a", "1", "a@", "1.", "+1", "AB12", "1-", "(555) "):
        docs = spark.createDataFrame([(1, part * (1_000_000 // len(part)))], "doc_id bigint, text string")
        assert pii.pii_digests(docs).count() == 1 and len(pii.pii_digests(docs).select("spans").collect()) == 1
    assert time.time() - took < 120


# -- spelling variants ----------------------------------------------------------------

def _one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _variants(texts):
    n = Counter()
    for d, t in texts:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(str.maketrans(variants._UPPER, variants._LOWER))
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 7:
                n[w] += 1
    n = {w: k for w, k in n.items() if k >= 2}
    meet = {}  # words one apart are equal, or one is the other, after one deletion at most
    for w in n:
        for d in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            meet.setdefault(d, []).append(w)
    near = {w: {o for d in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))} for o in meet[d] if o != w and _one_apart(o, w)} for w in n}
    form = {w: min(near[w], key=lambda o: (-n[o], o)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 10 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def test_variants_against_all_pairs(spark):
    rng = random.Random(8)
    words = [prose(rng, 1) * 2 + "ingly" for _ in range(40)]
    extra = []
    for i in range(60):
        text = []
        for w in words:
            if rng.random() < 0.5:
                text += [w] * rng.choice([1, 1, 2, 12])
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                text += [rng.choice([w[:k] + "é" + w[k + 1:], w[:k] + "Q" + w[k:], w[:k] + w[k + 1:]])] * 2
        extra.append((500 + i, " ".join(text), "s"))
    chain = " ".join(["abcdefgh"] * 2 + ["abcdefgx"] * 25 + ["abcdefyx"] * 300 + ["abcdwfyx"] * 3200)
    docs = awkward_docs(spark, [*extra, (None, chain, "s"), (901, "×÷ÀÿÀÿÀÿ ×÷ÀÿÀÿÀÿ ÉCOLESÉ ÉCOLESÉ", "s")])
    got = {tuple(r) for r in variants.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = _variants([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got == want
    assert len({w for w, f, *_ in want if f}) > 5
    assert variants.spelling_variants(no_docs(spark)).count() == 0


@pytest.mark.parametrize("qmax, extend", [(2, 0), (3, 3), (4, 20), (6, 0)])
def test_gram_lists_lose_no_pair(qmax, extend):
    """Also with a dictionary so long that the bound of many words leaves nothing."""
    rng = random.Random(qmax)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(7, 10))) for _ in range(150)}
    words |= {"".join(rng.choice("abcdefgh") for _ in range(rng.randint(7, 12))) for _ in range(100)}
    for w in list(words):
        k = rng.randrange(len(w))
        words |= {w[:k] + rng.choice("abz") + w[k + 1:], w[:k] + "c" + w[k:]}
    words = sorted(w for w in words if len(w) >= 7)
    counts = Counter(s[i:i + q] for w in words for s in [f"^{w}$"] for q in range(2, qmax + 1) for i in range(len(s) - q + 1))
    index = variants.GramIndex({g: n for g, n in counts.items() if len(g) == 2 or counts[g[:-1]] > extend}, 2, qmax)
    lists = {w: index.keys(w) for w in words}
    bounds = [len(index.cut(f"^{w}$")) - index.bound(f"^{w}$", index.cut(f"^{w}$")) for w in words]
    assert qmax < 6 or min(bounds) < 1
    met = {(a, b) for a, b in combinations(words, 2)
           if set(lists[a][0]) & set(lists[b][0]) or set(lists[a][0]) & set(lists[b][1]) or set(lists[a][1]) & set(lists[b][0])}
    pairs = {(a, b) for a, b in combinations(words, 2) if _one_apart(a, b)}
    assert pairs and pairs <= met


def test_bound_holds_for_every_edit():
    """No edit of a word loses more of its grams (by place) than the bound says."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(7, 11))) for _ in range(60)]
    counts = Counter(s[i:i + q] for w in words for s in [f"^{w}$"] for q in range(2, 6) for i in range(len(s) - q + 1))
    index = variants.GramIndex({g: n for g, n in counts.items() if len(g) == 2 or counts[g[:-1]] > 4}, 2, 5)
    for w in words:
        s = f"^{w}$"
        cut = index.cut(s)
        bound = index.bound(s, cut)
        for i in range(1, len(s)):
            edits = [(s[:i] + c + s[i:], i, i, 1) for c in "abcz"]
            if i < len(s) - 1:
                edits += [(s[:i] + c + s[i + 1:], i, i + 1, 0) for c in "abcz" if c != s[i]] + [(s[:i] + s[i + 1:], i, i + 1, -1)]
            for t, before, after, shift in edits:
                there = set(index.cut(t))
                kept = sum((b < before and (a, b) in there) or (a >= after and (a + shift, b + shift) in there) for a, b in cut)
                assert len(cut) - kept <= bound
