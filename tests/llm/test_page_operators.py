"""HTML extraction, WARC archives, top-k search and the pipeline."""

import gzip
import hashlib
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import htmltext, topk, warc

from .helpers import awkward_docs, no_docs, prose, rows
from .test_text_operators import labelled, secret_docs

PAGE_TYPE = "page_id bigint, url string, html string, text string, key string"


# ---- HTML ----------------------------------------------------------------

def page(body, title="T"):
    return (f"<!DOCTYPE html><html><head><title>{title}</title><script>var a='</p><article>';</script></head><body>"
            f"<nav><ul><li><a href='/x'>Menu entry</a></li></ul></nav><div class=\"ad\">Buy now</div>"
            f"<article>{body}</article><footer>&copy; owner</footer></body></html>")


PAGES = [
    (page("<h1>Head &amp; more</h1><p>One  two\n three<br>four</p><p>fi<b>ve</b> six&nbsp;x</p>"), "Head & more One two three four five six x"),
    (page("<p><b>Left open<br><p>next</p><!-- gone <p>no</p> --><style>p{}</style><form>Sign <input> up</form><aside>Other</aside><p>end</p>"),
     "Left open next end"),
    (page("<header><h2>Title</h2>by me</header><p>text</p><section class='comments'><article class='comment'><p>me too</p></article></section>"),
     "Title text"),
    ("<html><body class='has-sidebar'><header>Site name</header><div id='content'><h1>Real</h1><p>Body of some words here.</p>"
     "<div class='cookie-notice'>We use cookies</div><ul><li>item</li></ul></div><aside>Links</aside></body></html>",
     "Real Body of some words here. item"),
    ("<div class='ad'>open<article><p>inside</p></article>", "inside"),
    ("just text &lt;3", "just text <3"), ("<p title='a>b'>q", "q"), ("", ""), (None, ""), ("<nav>only menu</nav>", ""),
    ("<article><p>cut off &am", "cut off &am"), ("<article><p>x</p><script>never closed", "x"), ("<article>a<table><tr><td>1<td>2</table></article>", "a 1 2"),
]


@pytest.mark.parametrize("source,want", PAGES)
def test_main_text(source, want):
    words, tags = htmltext.learn_weights([s for s, _ in PAGES if s])
    assert htmltext.main_text(source, words, tags) == want


MENU = "<html><body><nav><a href='/x'>Menu</a></nav>"
UNFIT = [  # pages whose article markup does not hold the main text
    (f"{MENU}<main><p>{'body ' * 30}</p></main><article class='card'><p>teaser</p></article></body></html>", "body " * 30, ""),
    (f"{MENU}<div><p>{'body ' * 30}</p></div><article class='card'><p>teaser</p></article></body></html>", "body " * 30, ""),
    (f"{MENU}<article><p>{'one ' * 20}</p></article><p>{'two ' * 40}</p><article><p>{'three ' * 20}</p></article></body></html>",
     "one " * 20 + "two " * 40 + "three " * 20, ""),
    (f"{MENU}<div><p>{'body ' * 10}</p></div><section class='comments'><article><p>{'reply ' * 40}</p></article></section>", "body " * 10, "reply"),
]


@pytest.mark.parametrize("source,want,absent", UNFIT)
def test_learned_weights_decide_and_not_the_markup_of_the_page(source, want, absent):
    words, tags = htmltext.learn_weights([s for s, _ in PAGES if s])
    got = htmltext.main_text(source, words, tags)
    assert want.strip() in got and (not absent or absent not in got)
    # with other weights the same page gives another text
    assert htmltext.main_text(source, words | {"p": -htmltext.CLIP}, tags) != got


def test_pages_with_a_minor_article_or_several_are_no_labels():
    assert [htmltext.Page(s).label() for s, _, _ in UNFIT] == [1, 0, 0, 0]
    assert htmltext.Page(PAGES[0][0]).label() == 2


LEARNED = [f"<html><body><nav><a href=/>menu {i}</a></nav><article><h1>Title {i}</h1><p>{'some words of the article ' * 5}</p></article>"
           f"<footer>Copyright {i}</footer></body></html>" for i in range(40)]
ARTICLE = "the article has a good many words of its own " * 12


@pytest.mark.parametrize("source, want, absent", [
    (f'<div class="layout has-sidebar"><div class="content"><p>{ARTICLE}</p></div><div class="sidebar"><p>side words</p></div></div>', ARTICLE, "side"),
    (f'<div id="share-price-report"><p>{ARTICLE}</p></div><div class="share-buttons"><p>Share me</p></div>', ARTICLE, "Share"),
    (f'<div class="page search-enabled"><p>{ARTICLE}</p></div><div class="search"><p>find it</p></div>', ARTICLE, "find"),
    (f'<div><p>{ARTICLE}</p><section class="related-work"><p>we build on this</p></section><div class="related-posts"><p>More to read</p></div></div>',
     ARTICLE + "we build on this", "More"),
    (f'<div class="sponsored"><div class="ad-slot"><p>buy this</p></div><p>{ARTICLE}</p></div>', ARTICLE, "buy")])
def test_wrappers_named_after_their_parts_keep_their_article(source, want, absent):
    text = htmltext.main_text(source, *htmltext.learn_weights(LEARNED))
    assert " ".join(want.split()) in text and absent not in text


@pytest.mark.parametrize("part", ["<b>x y ", "<div>x y ", "<div class=ad>x y ", "<p>x y ", "</i>x ", '<b ">x', "<a href='x>y ", "<article>x ", "<header>x "])
def test_page_time_is_in_proportion(part):
    weights = htmltext.learn_weights(LEARNED)

    def took(n):
        began = time.process_time()
        htmltext.main_text(part * (n // len(part)), *weights)
        return time.process_time() - began
    took(2_000)
    assert took(320_000) < 24 * max(took(40_000), 0.01)


def test_best_region_matches_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        spans = [(sum(scores[a:b]), -a, -(b - a), (a, b)) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        best = max(spans, default=(0,))
        a, b = htmltext.best_region(scores)
        assert sum(scores[a:b]) == max(0, best[0])


def test_extract_pages(spark):
    data = [(i, f"http://e.org/{i}", s, "clash", "clash") for i, (s, _) in enumerate(PAGES)] + [(None, None, PAGES[0][0], None, None)]
    got = htmltext.extract_pages(spark.createDataFrame(data, PAGE_TYPE))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(i, f"http://e.org/{i}", t, len(t)) for i, (_, t) in enumerate(PAGES)] + [(None, None, PAGES[0][1], len(PAGES[0][1]))]
    assert rows(got, *got.columns) == sorted(want, key=repr)
    assert htmltext.extract_pages(spark.createDataFrame([], PAGE_TYPE)).count() == 0
    long = "<article>" + "<p>word &amp; word</p>" * 50_000 + "</article>"
    assert htmltext.main_text(long, {}, {}) == " ".join(["word & word"] * 50_000)


# ---- WARC ----------------------------------------------------------------

def test_url_key():
    assert warc.url_key("http://www.Example.org/a?b#c") == "org,example)/a?b#c"
    assert warc.url_key("https://u:p@m.x.co.uk:8080") == "uk,co,x,m:8080)/"
    assert warc.url_key(None) == "" and warc.url_key("no host\there") == "no%20host%09here"


def some_pages(spark):
    rng = random.Random(2)
    same = "<p>" + prose(rng, 60) + "</p>"
    data = [(i, f"http://h{i % 7}.org/{i}", "<p>" + prose(rng, 50) + "</p>") for i in range(200)]
    data += [(1000 - i, "http://hot.org/", same) for i in range(50)] + [(951, "http://hot.org/", same), (None, "http://hot.org/", same)]
    data += [(2000, None, None), (2001, None, ""), (2002, "http://a b.org/\r\nX: y", "small"), (2003, "http://c.org", "small"),
             (2004, "http://d.org", "é" * 60), (2005, "", "é" * 60), (2006, "http://big.org", prose(rng, 100_000))]
    return spark.createDataFrame([(a, b, c, "clash", "clash") for a, b, c in data], PAGE_TYPE), data


def test_archives_round_trip(spark, tmp_path):
    df, data = some_pages(spark)
    captures = warc.write_archives(df, f"{tmp_path}/archive")
    files = warc.write_index(captures, f"{tmp_path}/index", block_lines=10)
    read = warc.read_captures(captures, f"{tmp_path}/archive", f"{tmp_path}/index", files, payload=True, tasks=5)
    assert read.rdd.getNumPartitions() == 5
    got = read.collect()
    assert len(got) == len(data)
    first = {}
    for i, _, h in data:
        raw = (h or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(i, first.get(raw, i))
    want = []
    for i, u, h in data:
        raw = (h or "").encode()
        again = len(raw) >= 100 and i != first[raw]
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    text = {i: (h or "").encode() for i, _, h in data}
    assert all(bytes(r.payload) == text[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)
    # every archive is a plain sequence of gzip members that other tools can read
    whole = b"".join(gzip.decompress(open(os.path.join(tmp_path, "archive", f), "rb").read()) for f in os.listdir(tmp_path / "archive") if f.endswith(".gz"))
    assert whole.count(b"WARC/1.1\r\n") == len(data)


def test_lookup_by_binary_search(spark, tmp_path):
    df, _ = some_pages(spark)
    captures = warc.write_archives(df, f"{tmp_path}/a")
    files = warc.write_index(captures, f"{tmp_path}/i", block_lines=7)
    tops = sorted((r.first_key, r.file) for r in files.collect())
    reader = warc.Reader(f"{tmp_path}/a", f"{tmp_path}/i", tops)
    for r in captures.collect():
        assert reader.find(r.key) == (r.file, r.offset, r.length) and reader.find(r.key + "x") is None
    assert reader.find("") is None and reader.find("zzz") is None
    assert sum(r.lines for r in files.collect()) == captures.count()


def test_warc_query_on_nothing(spark):
    assert warc.archive_and_read(spark, spark.createDataFrame([], PAGE_TYPE)).count() == 0
    df, data = some_pages(spark)
    got = warc.archive_and_read(spark, df)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] and got.count() == len(data)


# ---- top-k ---------------------------------------------------------------

def brute_top(data, k, scale=64, every=20):
    ok = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in data
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in ok if j != i and len(c) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    data += [(300 + i, [0.5] * 8) for i in range(40)]  # ties
    data += [(None, [1.0] * 8), (400, None), (420, [1.0, None] * 4), (440, [float("nan")] * 8), (460, [float("inf")] + [0.0] * 7),
             (480, [1.0, 2.0]), (500, [3.0, 1.0]), (520, []), (7, data[7][1]), (20, data[20][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in data], "vec_id bigint, embedding array<float>, block int, score int")
    got = topk.exact_top_k(df, F.col("vec_id") % 20 == 0, k=5, shard_rows=37, block_rows=4)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect())) == brute_top(data, 5)
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_beyond_doubles():
    c_ids = np.array([1, 2, 3])
    big = topk.quantise(np.array([[1e18, 1.0], [1e18, 2.0], [-1e18, 0.0]]))
    got = list(topk.tile_top(np.array([9]), topk.quantise(np.array([[3.0, 1.0]])), c_ids, big, 2))
    assert got[0][0] == [2, 1]
    far = list(topk.tile_top(np.array([9]), big[:1], c_ids, big, 3))
    assert far[0][1][0] == (1 << 63) - 1 and far[0][1][2] == 1 - (1 << 63)


# ---- pipeline ------------------------------------------------------------

def test_pipeline_stages_compose(spark, tmp_path):
    import corpus_pipeline
    made, truth = secret_docs(spark, 60)
    docs, labels, _ = labelled(spark)
    table = awkward_docs(spark, [(10_000 + d, t, s) for d, t, s in made] + [(20_000 + r.doc_id, r.text, "s9") for r in docs.collect()])
    sf = str(tmp_path)
    table.write.parquet(f"{sf}/documents.parquet")
    labels.where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 20_000).write.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secret_scan", "mixing_weights", "sentencepiece"]
    now, step = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, sf).write.parquet(f"{sf}/{name}")
        now = step[name] = spark.read.parquet(f"{sf}/{name}")
        if name != "sentencepiece":
            assert now.columns == table.columns
    ids = {n: [r.doc_id for r in f.select("doc_id").collect()] for n, f in step.items()}
    assert 100 in ids["near_duplicates"] and 101 not in ids["near_duplicates"] and 101 in ids["quality_rules"]
    assert sorted(ids["secret_scan"], key=repr) == sorted(ids["near_duplicates"], key=repr)
    left = " ".join(r.text or "" for r in step["secret_scan"].collect())
    assert not any(v in left for v in truth.values() if v)
    assert set(ids["mixing_weights"]) <= set(ids["secret_scan"]) and sorted(ids["sentencepiece"], key=repr) == sorted(ids["mixing_weights"], key=repr)
    assert corpus_pipeline.run(spark, sf).count() == step["sentencepiece"].count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs(spark), sf).count() == 0
