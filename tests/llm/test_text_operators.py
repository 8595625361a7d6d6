"""Quality rules, SimHash, classifiers, secrets, tokens and mixing."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import common, components, compression, mixing, oracle, pieces, quality, queries, secrets, simhash, toxicity

from .helpers import awkward_docs, count_ids, no_docs, prose, rows

WORD = re.compile("[^\x20\x09-\x0d]+")


# ---- quality rules -------------------------------------------------------

def brute_measure(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    wins = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    n = Counter(wins)
    covered = {j for i, w in enumerate(wins) if n[w] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_measures_match_brute_force():
    rng = random.Random(1)
    texts = ["", "a", "a b c d e", "a b c d e a b c d e", "x\n\nx\n x\nx", "é é é é é é é é é", "#a *b $|<>%& c", "one two three"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(50)]
    for t in texts:
        assert quality.measure(t.encode())[:5] == brute_measure(t), t
    assert quality.measure(None) == (0,) * 6


def test_repeated_words_where_codes_do_not_fit_one_number():
    rng = random.Random(2)
    words = [str(rng.randint(0, 9000)).encode() for _ in range(20_000)]
    words += words[100:140]
    assert quality.repeated_words(words) == brute_measure(b" ".join(words).decode())[4] >= 80


def test_quality_rules_on_awkward_rows(spark):
    docs = awkward_docs(spark)
    got = quality.quality_rules(docs)
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = sorted(((r.doc_id, *brute_measure(r.text)) for r in docs.collect()), key=repr)
    assert rows(got, *got.columns[:6]) == want
    assert quality.quality_rules(no_docs(spark)).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()
    assert quality.keep_good(no_docs(spark)).count() == 0


def test_hosts_that_mostly_fail_are_rejected_and_small_ones_shrunk(spark):
    rng = random.Random(3)
    good = lambda: prose(rng, 30)
    data = [(i, "spam " * 30 if i % 10 else good(), "bad") for i in range(200)]
    data += [(1000 + i, good(), f"ok{i % 5}") for i in range(500)] + [(2000, "too short", "tiny"), (2001, good(), "tiny")]
    docs = spark.createDataFrame([(a, b, c) for a, b, c in data], "doc_id bigint, text string, source string")
    got = {r.doc_id: r.kept for r in quality.quality_rules(docs).collect()}
    assert not any(got[i] for i in range(200))
    assert all(got[1000 + i] for i in range(500)) and got[2001] and not got[2000]


def test_host_verdicts_match_sql(spark, tmp_path):
    """Hosts of 1 to 400 documents with failure rates from none to all: verdicts
    that shrinking turns, both ways, are those of the SQL."""
    rng = random.Random(9)
    sizes = [(1, 1.0), (2, 1.0), (3, 0.67), (5, 0.6), (8, 0.5), (20, 0.55), (60, 0.5), (150, 0.45), (400, 0.9), (400, 0.02), (90, 0.0)]
    data = []
    for host, (n, share) in enumerate(sizes * 2):
        for i in range(n):
            bad = rng.choice(["spam " * 40, "# $ % & | < >" * 8 + " word" * 3, "few words", None])
            data.append((len(data), bad if i < share * n else prose(rng, 40), f"host{host}" if host else None))
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    got = quality.quality_rules(docs)
    want = con.execute(oracle.sql()["op4_quality_rules"]).df()
    assert rows(got, *got.columns) == sorted((tuple(x) for x in want[got.columns].itertuples(index=False)), key=repr)
    turned = got.where("not base_failed and not kept").count()
    assert 0 < turned < got.where("not base_failed").count()
    verdicts = {r.source: r for r in quality.host_verdicts(docs.join(got, "doc_id").select(
        "source", F.col("base_failed").alias("failed"))).collect()}
    raw = lambda r: r.n_failed / r.n_docs
    assert any(raw(r) >= quality.MAX_HOST_RATE > r.rate for r in verdicts.values()) and any(r.rejected for r in verdicts.values())


def test_beta_prior():
    assert quality.beta_prior(0, 0, 0, 0.0) == (0.5, 0.5)
    a, b = quality.beta_prior(4, 400, 40, 4 * 100 / 100)  # all hosts alike
    assert a + b == pytest.approx(quality.MAX_PRIOR) and a / (a + b) == pytest.approx(0.1)
    a, b = quality.beta_prior(2, 200, 100, 100 * 100 / 100)  # one host fails all, one none
    assert a + b == pytest.approx(1.0)


def test_task_count(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert common.task_count(spark, 0, 100, 10) == 1 and common.task_count(spark, 25, 1000, 10) == min(parts, 3)
    assert common.task_count(spark, 10 ** 6, 100, 10) == 10 ** 4 and common.task_count(spark, 10 ** 6, 10 ** 6, 10) == parts


# ---- SimHash -------------------------------------------------------------

def brute_fingerprint(text, k=4):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(items, bits=4):
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(items)):
        for j in range(i):
            if (items[i] ^ items[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(items))]


def test_fingerprints_match_brute_force():
    rng = random.Random(4)
    for t in ["", " ", "A b", "a b c d", "ÀB c D e é", "a b c d e f g", *[prose(rng, n) for n in (3, 4, 5, 90)], None]:
        assert simhash.fingerprint(t.encode() if t is not None else None) == brute_fingerprint(t)


@pytest.mark.parametrize("bits,segments", [(4, 3), (4, 5), (3, 2), (4, 2), (0, 2), (7, 4)])
def test_segment_plan_never_misses(bits, segments):
    plan = simhash.segment_plan(bits, segments)
    assert sum(w for _, w, _ in plan) == 64 and sum(r + 1 for _, _, r in plan) == bits + 1
    rng = random.Random(6)
    for _ in range(300):
        x = sum(1 << b for b in rng.sample(range(64), bits))
        assert any((x >> o & (1 << w) - 1).bit_count() <= r for o, w, r in plan)


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(7)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for base in list(prints)[:12]:
        for _ in range(25):  # dense groups and chains
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp bigint")).collect()
    where = {s: i for i, s in enumerate(signed)}
    assert all((prints[where[e.u]] ^ prints[where[e.v]]).bit_count() <= 4 for e in edges)
    found = components.connected_components(spark.createDataFrame([(e.u, e.v) for e in edges], "u bigint, v bigint"))
    root = {s: s for s in signed} | {r.node: r.root for r in found.collect()}
    brute = brute_components(prints)
    groups = lambda labels: sorted(map(sorted, [[i for i, x in enumerate(labels) if x == y] for y in set(labels)]))
    assert groups([root[s] for s in signed]) == groups(brute)


def test_simhash_on_awkward_rows(spark):
    rng = random.Random(8)
    base = prose(rng, 400).split()
    near = [" ".join([*base[:k], "changed", *base[k + 1:]]) for k in (5, 200, 390)]
    docs = awkward_docs(spark, [(300, " ".join(base), "s1"), *[(301 + i, t, "s1") for i, t in enumerate(near)]])
    got = simhash.simhash_components(docs).collect()
    items = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    roots = brute_components([f for _, f in items])
    least = {}
    for (d, _), r in zip(items, roots):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = sorted(((d, f"{f:016x}", least.get(r)) for (d, f), r in zip(items, roots)), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))
    ids = [r.doc_id for r in kept.collect()]
    assert 100 in ids and not {101, 102, 103, 104, 105} & set(ids)
    assert simhash.simhash_components(no_docs(spark)).count() == 0 and simhash.drop_near_duplicates(no_docs(spark)).count() == 0


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (5, None)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# ---- classifiers ---------------------------------------------------------

def labelled(spark, n=400, seed=9):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 5 == 1
        words = prose(rng, rng.randint(40, 120)).split()
        if bad:
            words = [w for w in words[: len(words) // 4] for _ in range(4)]
        if toxic:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(["grumbleknot", "snarkface", "blatherskite"]) + rng.choice(["", "s", "ed"]))
        docs.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(not bad), int(toxic)))
    labels += [(None, 1, 1), (1, None, None), labels[0]]
    return (spark.createDataFrame(docs, "doc_id bigint, text string"),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
            {d: (int(d % 4 != 0), int(d % 5 == 1)) for d, _ in docs})


def test_toxicity_held_out_accuracy_and_edges(spark):
    docs, labels, truth = labelled(spark)
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == 400 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in held]) > 0.95
    again = toxicity.toxicity_scores(docs, labels).collect()
    assert sorted(got) == sorted(again)
    odd = toxicity.toxicity_scores(awkward_docs(spark), labels)
    assert odd.count() == awkward_docs(spark).count() and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.toxicity_scores(no_docs(spark), labels).count() == 0
    assert toxicity.toxicity_scores(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_toxicity_is_fitted_on_2500_positives_and_7500_unlabelled(spark, monkeypatch):
    docs = spark.range(11_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word number "), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") < 4000).cast("int").alias("toxic"))
    sizes = []
    monkeypatch.setattr(toxicity, "fit_nnpu", lambda positive, unlabelled, prior: sizes.append((len(positive), len(unlabelled))) or ({}, 0.0))
    toxicity.fit(docs, labels)
    assert sizes == [(2500, 7500)]


def test_nnpu_learns_from_positives_and_unlabelled_only():
    rng = np.random.default_rng(0)
    clean = [{f"w{k}" for k in rng.integers(0, 200, 30)} for _ in range(600)]
    toxic = [{f"w{k}" for k in rng.integers(0, 200, 30)} | {"bad"} for _ in range(200)]
    weights, bias = toxicity.fit_nnpu(toxic[:100], clean + toxic[100:150], prior=0.08, features=lambda x: x)
    score = lambda x: bias + sum(weights.get(f, 0) for f in x)
    assert all(score(x) > 0 for x in toxic[150:]) and np.mean([score(x) < 0 for x in clean]) > 0.99


def test_quality_held_out_accuracy_and_edges(spark):
    docs, labels, truth = labelled(spark, 800)
    got = compression.quality_scores(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 800 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id][0] for r in held]) > 0.95
    odd = compression.quality_scores(awkward_docs(spark), labels)
    assert odd.count() == awkward_docs(spark).count() and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert compression.quality_scores(no_docs(spark), labels).count() == 0
    assert {r.score for r in compression.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


# ---- secrets -------------------------------------------------------------

def secret_docs(spark, n=300):
    rng = random.Random(10)
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    made, truth = [], {}
    for i in range(n):
        kind = i % 6
        value = [hexa(40), hexa(18), key(), str(rng.randint(10**15, 10**16)), "https://ex.org/" + prose(rng, 1) + "12345abc", ""][kind]
        put = [f'token = "{value}"', f"password={value}", value, value, value, ""][kind]
        made.append((i, f"{prose(rng, 20)} {put} {prose(rng, 20)}", "s"))
        truth[i] = value if kind < 3 else None
    return made, truth


def test_secrets_are_found_and_masked(spark):
    made, truth = secret_docs(spark)
    docs = awkward_docs(spark, [(10_000 + d, t, s) for d, t, s in made])
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    found = secrets.scan_secrets(docs).collect()
    hits = {(r.doc_id, text[r.doc_id][r.start:r.start + r.n_chars]) for r in found if r.is_secret and r.doc_id is not None}
    assert hits == {(10_000 + d, v) for d, v in truth.items() if v}
    assert any(not r.is_secret for r in found)
    masked = secrets.mask_secrets(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    after = {r.doc_id: r for r in masked.collect()}
    for d, v in truth.items():
        want = text[10_000 + d].replace(v, secrets.MASK) if v else text[10_000 + d]
        assert after[10_000 + d].text == want and after[10_000 + d].n_chars == len(want)
    assert after[2].text is None and after[3].text == ""
    assert secrets.scan_secrets(no_docs(spark)).count() == 0 and secrets.mask_secrets(no_docs(spark)).count() == 0


def planted_kinds(n=12):
    rng = random.Random(20)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    some = lambda k, of: "".join(rng.choice(of) for _ in range(k))
    kinds = {"query": lambda: ("ghp_" + some(36, letters + "0123456789"), "https://h.org/?access_token={}&page=2"),
             "named query": lambda: (some(14, letters + "0123456789") + "a1B2c3", "https://h.org/a/b?password={}#top"),
             "user": lambda: ("ghp_" + some(36, letters + "0123456789"), "https://{}@github.com/a/b.git"),
             "password": lambda: (some(9, letters) + "7", "postgres://user:{}@host.org:5432/db"),
             "path": lambda: ("AKIA" + some(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), "https://h.org/files/{}/raw"),
             "letters": lambda: (some(28, letters), 'token = "{}"')}
    return [(kind, *make()) for kind, make in kinds.items() for _ in range(n)]


def test_secrets_in_urls_and_without_digits(spark):
    """Among few of their kind, beside plain paths, mail addresses and long words."""
    rng = random.Random(21)
    planted = planted_kinds(2)
    made, _ = secret_docs(spark)
    plain = [f"https://ex.org/{prose(rng, 1)}12345abcde/x", "user1000000007@mail.org"]
    docs = [*made]
    docs += [(1000 + i, f"{prose(rng, 15)} {where.format(value)} {prose(rng, 15)}", "s") for i, (_, value, where) in enumerate(planted)]
    docs += [(2000 + i, f"{prose(rng, 15)} {plain[i % 2]} and donaudampfschifffahrtsgesellschaft {prose(rng, 15)}", "s") for i in range(20)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    text = {d: t for d, t, _ in docs}
    hits = {(r.doc_id, text[r.doc_id][r.start:r.start + r.n_chars]) for r in secrets.scan_secrets(table).collect() if r.is_secret}
    assert {(1000 + i, value) for i, (_, value, _) in enumerate(planted)} == {h for h in hits if 1000 <= h[0] < 2000}
    assert not [h for h in hits if h[0] >= 2000]
    after = {r.doc_id: r.text for r in secrets.mask_secrets(table).collect()}
    for i, (_, value, _) in enumerate(planted):
        assert after[1000 + i] == text[1000 + i].replace(value, secrets.MASK)


def test_bare_tokens_without_a_digit_are_candidates_and_judged(spark):
    rng = random.Random(22)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    bare = ["".join(rng.choice(letters) for _ in range(32)) for _ in range(40)]
    made, _ = secret_docs(spark)
    docs = [*made, *((1000 + i, f"{prose(rng, 15)} {'' if i % 2 else 'token = '}{b} {prose(rng, 15)}", "s") for i, b in enumerate(bare))]
    found = secrets.scan_secrets(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).where("doc_id >= 1000").collect()
    assert {r.digest for r in found} == {hashlib.sha256(b.encode()).hexdigest() for b in bare}
    judged = {r.digest: r.is_secret for r in found}
    assert np.mean([judged[hashlib.sha256(b.encode()).hexdigest()] for b in bare]) > 0.9


def test_the_dictionary_counts_all_words_of_all_whole_texts(spark, monkeypatch):
    rng = random.Random(23)
    data = [(i, prose(rng, 5)) for i in range(2500)] + [(3000 + i, "Ödipus zzyzx " * 2500) for i in range(2)] + [(None, "nullid " * 9), (None, None)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    counts = Counter(w for _, t in data for w in re.findall(r"[^\W\d_]{3,}", (t or "").lower()))
    monkeypatch.setattr(secrets, "DICTIONARY", 50)
    got = secrets.learn_language(docs)
    assert got.words == set(sorted(counts, key=lambda w: (-counts[w], w))[:50]) >= {"zzyzx", "ödipus"}
    pairs = np.ones((27, 27))
    for w, n in counts.items():
        codes = ["abcdefghijklmnopqrstuvwxyz".find(c) % 27 for c in w]
        np.add.at(pairs, (codes[:-1], codes[1:]), n)
    assert np.allclose(got.logp, np.log(pairs / pairs.sum(axis=1, keepdims=True)))
    again = secrets.learn_language(docs.repartition(7))
    assert again.words == got.words and (again.logp == got.logp).all()


def test_forest_separates_and_handles_one_class():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(secrets.FEATURES))).astype(np.float32)
    y = ((x[:, 0] > 0) & (x[:, 3] > 0)).astype(int)
    p = secrets.Forest.fit(x, y).score(x)
    assert ((p >= 0.5) == y).mean() > 0.9
    assert secrets.Forest.fit(x, np.ones(400, int)).score(x).tolist() == [1.0] * 400
    assert secrets.Forest.fit(x[:0], y[:0]).score(x).tolist() == [0.0] * 400


# ---- SentencePiece -------------------------------------------------------

def test_pieces_are_those_of_the_sentencepiece_library(spark):
    import sentencepiece
    model = queries.model_bytes()
    docs = awkward_docs(spark, [(400, "  two  spaces ", "s"), (401, "▁ mark▁s", "s"), (402, "<s> </s> <unk> <0x41>", "s"), (403, "a\r\n\tb", "s")])
    other = sentencepiece.SentencePieceProcessor(model_proto=model)
    text = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    got = sorted(((r.doc_id, r.n_tokens, list(r.ids)) for r in pieces.encode_documents(docs, model).collect()), key=repr)
    assert sorted(((d, len(i), i) for d, i in ((d, other.encode(t or "")) for d, t in text)), key=repr) == got
    assert pieces.parity(model, [t for _, t in text if t is not None]) == []
    both = pieces.encode_and_decode(docs, model)
    # a marker that stands in a text itself comes back as a space
    assert [r.doc_id for r in both.where("not same_text").collect()] == [401] and both.count() == docs.count()
    ids = docs.select("doc_id", pieces.encode_column(F.col("text"), model).alias("ids"))
    back = ids.select("doc_id", pieces.decode_column(F.col("ids"), model).alias("text"))
    assert rows(back, "doc_id", "text") == [(d, t and t.replace("▁", " ")) for d, t in text]
    assert pieces.encode_documents(no_docs(spark), model).count() == 0


def test_pieces_of_a_documents_table_are_those_of_the_sentencepiece_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("lang", "text").collect()
    texts = [r.text for r in docs]
    texts.append("\n".join(texts[:200]))  # longer than any, in all languages
    assert len({r.lang for r in docs}) >= 4 and max(map(len, texts)) > 50_000
    model = queries.model_bytes()
    assert pieces.read_model(model)["type"] != pieces.UNIGRAM
    assert pieces.parity(model, texts) == []


def test_unigram_models_from_their_protobuf():
    """A hand-made unigram model: fields are written by this test, byte by byte."""
    import struct
    size = lambda b: bytes([len(b)]) + b if len(b) < 128 else bytes([len(b) & 127 | 128, len(b) >> 7]) + b
    piece = lambda p, s, t: b"\x0a" + size(b"\x0a" + size(p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([t]))
    vocab = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *[(f"<0x{b:02X}>", 0, 6) for b in range(256)]]
    vocab += [("▁", -2, 1), ("▁he", -1.5, 1), ("llo", -1.2, 1), ("▁hello", -4, 1), ("l", -3, 1), ("o", -3, 1), ("h", -3, 1), ("e", -3, 1)]
    model = b"".join(piece(*x) for x in vocab)
    model += b"\x12" + size(b"\x18\x01" + b"\x98\x02\x01" + b"\xc0\x02\x00") + b"\x1a" + size(b"\x18\x01\x20\x00\x28\x01")
    parsed = pieces.read_model(model)
    assert parsed["type"] == pieces.UNIGRAM and parsed["byte_fallback"] and parsed["dummy_prefix"] and not parsed["squeeze"]
    assert pieces.parity(model, ["hello hello", "he llo", "", "hé🙂llo", " hell o "]) == []


# ---- mixing --------------------------------------------------------------

def test_mixing_matches_brute_force(spark):
    docs, labels, _ = labelled(spark)
    targets = {"good": 0.9, "low": 0.07, "toxic": 0.03}
    known = queries.labelled_domains(labels)
    got = mixing.mixing_rates(docs, known, targets).collect()
    n = np.array([r.n_tokens for r in got], float)
    p = np.array([[r.p_good, r.p_low, r.p_toxic] for r in got])
    rate = np.array([r.rate for r in got])
    assert np.allclose(p.sum(axis=1), 1) and (rate >= 0).all() and len(got) == 400
    expected = (n * rate) @ p
    target = np.array([0.9, 0.07, 0.03]) * (n @ p[:, 0]) / 0.9
    # plain projected gradient steps in numpy come no nearer to the targets
    w = np.linalg.inv((p * n[:, None]).T @ p)
    loss = lambda t: (t - target) @ w @ (t - target)
    r = np.ones(len(n))
    for _ in range(5000):
        r = np.maximum(0, r - p @ (w @ ((n * r) @ p - target)))
    assert loss(expected) <= 1.05 * loss((n * r) @ p) + 1e-3 * loss(n @ p)
    domain = {r.doc_id: r.domain for r in known.collect()}
    best = [max(zip((x.p_good, x.p_low, x.p_toxic), targets))[1] == domain[x.doc_id] for x in got if x.doc_id in domain]
    assert np.mean(best) > 0.8


def test_posteriors_match_brute_force(spark):
    docs, labels, _ = labelled(spark, 200)
    names = ["good", "low", "toxic"]
    known = queries.labelled_domains(labels)
    words = {r.token: (r.w_0, r.w_1, r.w_2) for r in mixing.learn_words(docs, known, names).collect()}
    # the counts behind the evidence, from the driver's own reading of the rows
    tokens = {r.doc_id: set(r.tokens) for r in mixing._rows(docs, "doc_id").collect()}
    domain = {}
    for r in known.where("doc_id is not null").collect():
        domain[r.doc_id] = min(r.domain, domain.get(r.doc_id, r.domain))
    size = Counter(domain.values())
    for token, w in words.items():
        if token != mixing._DOC:
            for d, x in zip(names, w):
                c = sum(token in tokens[i] for i in domain if domain[i] == d)
                rate = (c + mixing.SMOOTHING) / (size[d] + 2 * mixing.SMOOTHING)
                assert x == pytest.approx(mixing.TEMPER * np.log(rate / (1 - rate)))
    for r in mixing.mixing_rates(docs, known, dict.fromkeys(names, 1.0)).collect():
        z = np.sum([words[t] for t in tokens[r.doc_id] if t in words], axis=0)
        e = np.exp(z - z.max())
        assert np.allclose([r.p_good, r.p_low, r.p_toxic], e / e.sum())


def test_fit_says_whether_targets_are_met(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([1.0, 1.0, 1.0], 300)
    data = [(i, int(rng.integers(5, 200)), *map(float, x)) for i, x in enumerate(p)]
    data += [(900, 0, 0.2, 0.3, 0.5), (901, 0, 0.2, 0.3, 0.5)]
    members = spark.createDataFrame(data, "id int, n_tokens long, p_0 double, p_1 double, p_2 double")
    met = mixing.fit_rates(members, [0.6, 0.3, 0.1])
    assert met.converged and met.gap <= mixing.TOLERANCE
    # every document holds a tenth of the third domain: a share of nothing is out of reach
    far = members.selectExpr("id", "n_tokens", "0.9 * p_0 as p_0", "0.9 * (p_1 + p_2) as p_1", "double(0.1) as p_2")
    with pytest.warns(UserWarning, match="out of reach"):
        fit = mixing.fit_rates(far, [0.5, 0.5, 0.0])
    assert fit.converged and fit.gap > mixing.OFF
    rows = far.withColumn("r", mixing.rate_column(fit.steps)).collect()
    n, q, r = (np.array([list(x) if isinstance(x, tuple) else x for x in c], float) for c in
               ([x.n_tokens for x in rows], [(x.p_0, x.p_1, x.p_2) for x in rows], [x.r for x in rows]))
    target = np.array([0.5, 0.5, 0.0]) * (n @ q[:, 0]) / 0.5
    assert np.abs((n * r) @ q - target).max() / target.sum() == pytest.approx(fit.gap)
    # the optimum's condition: no gradient where a rate is positive, none downwards at zero
    w = np.linalg.pinv((q * n[:, None]).T @ q)
    step = np.maximum(0, r - q @ (w @ ((n * r) @ q - target))) - r
    assert n @ np.abs(step) <= 2 * mixing.STILL * (n @ r)
    cut = mixing.MAX_STEPS
    try:
        mixing.MAX_STEPS = 0
        with pytest.warns(UserWarning, match="not reached in 0 steps"):
            assert not mixing.fit_rates(members, [0.6, 0.3, 0.1]).converged
    finally:
        mixing.MAX_STEPS = cut


def test_mixing_on_awkward_rows(spark):
    _, labels, _ = labelled(spark)
    docs, known = awkward_docs(spark), queries.labelled_domains(labels)
    got = mixing.mixing_rates(docs, known, queries.MIX_TARGETS)
    assert got.count() == docs.count() and got.where("rate is null or rate < 0 or copies is null").count() == 0
    mixed = mixing.mix(docs, known, queries.MIX_TARGETS)
    assert mixed.columns == docs.columns
    wanted = {r[0]: r[1] for r in got.groupBy("doc_id").agg(F.sum("copies")).collect() if r[1]}
    assert count_ids(mixed) == wanted
    assert mixing.mix(no_docs(spark), known, queries.MIX_TARGETS).count() == 0
    assert mixing.mixing_rates(docs, known.limit(0), {"good": 1.0, "low": 1.0}).count() == docs.count()
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
