"""Independent DuckDB SQL for each query of the registry.

The derived inputs (G1, L1, V1, W1, P1, spliced text) are restated here in
SQL from the same rules as ``fixtures.py``. Column names and types match the
Spark results; doubles are rounded to the same number of places.
"""

from __future__ import annotations

from ..functions import patterns as P
from .fixtures import PARTIAL_SEEDS
from .flow import MAX_DEPTH
from .ml_queries import FIT_L1, FIT_L2, FIT_RATE, FIT_STEPS, NET_FILTERS, NET_HIDDEN, NET_POOLS, NET_WIDTH, PIPELINE_DIMS

NL = "chr(10)"
R1 = P.NUMERIC_BRACKETS
R2 = P.WORD_RUN
DIGITS = 6


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP_LIST = "[" + ", ".join(_q(w) for w in P.ENGLISH_STOP_WORDS) + "]"


def rnd(expr: str) -> str:
    return f"(round({expr}, {DIGITS}) + 0.0)"


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def tokens_of(text: str) -> str:
    return f"regexp_extract_all(lower({text}), {_q(R2)})"


def drop_blank(text: str) -> str:
    return (f"array_to_string(list_filter(string_split({text}, {NL}), "
            f"lambda l: NOT regexp_matches(l, '^\\s*$')), {NL})")


def clean(text: str) -> str:
    return f"regexp_replace(replace({drop_blank(text)}, 'Category:', ''), {_q(R1)}, '\\1', 'g')"


def html_plain(html: str) -> str:
    c = html
    for pat in P.HTML_DROP:
        c = f"regexp_replace({c}, {_q(pat)}, '', 'g')"
    c = f"regexp_replace({c}, {_q(P.HTML_TAG)}, ' ', 'g')"
    for ent, ch in P.HTML_ENTITIES:
        c = f"replace({c}, {_q(ent)}, chr({ord(ch)}))"
    return f"trim(regexp_replace({c}, {_q(P.HTML_SPACE_RUN)}, ' ', 'g'))"


G1 = """g1_page AS (
  SELECT CAST(r_regionkey AS BIGINT) + 1000000000 AS page_id, r_name AS page_title FROM region
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 2000000000, n_name FROM nation
  UNION ALL SELECT CAST(c_custkey AS BIGINT) + 3000000000, c_name FROM customer),
g1_links AS (
  SELECT CAST(r_regionkey AS BIGINT) + 1000000000 AS cl_from, 'ROOT' AS cl_to, 'subcat' AS cl_type FROM region
  UNION ALL SELECT CAST(n.n_nationkey AS BIGINT) + 2000000000, r.r_name, 'subcat'
    FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  UNION ALL SELECT CAST(c.c_custkey AS BIGINT) + 3000000000, n.n_name, 'subcat'
    FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  UNION ALL SELECT CAST(s.s_suppkey AS BIGINT) + 4000000000, n.n_name, 'page'
    FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
  UNION ALL SELECT CAST(o.o_orderkey AS BIGINT) + 5000000000, c.c_name, 'page'
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""

WALK = """walk(cat, lvl) AS (
  SELECT 'ROOT', 0
  UNION
  SELECT p.page_title, w.lvl + 1 FROM walk w
    JOIN g1_links l ON l.cl_to = w.cat AND l.cl_type = 'subcat'
    JOIN g1_page p ON p.page_id = l.cl_from
  WHERE w.lvl < 3)"""

DESCENT = ("SELECT DISTINCT cl_from AS page_id FROM g1_links "
           "WHERE cl_type = 'page' AND cl_to IN (SELECT cat FROM walk)")

FLAGS = """SELECT doc_id, 'quality' AS label FROM labels WHERE quality = 1
  UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1"""
L1 = f"""l1 AS (
  SELECT doc_id, 'lang=' || lang AS label FROM documents
  UNION ALL SELECT doc_id, 'source=' || source FROM documents
  UNION ALL {FLAGS})"""
L1B = f"l1 AS ({FLAGS})"

DICT = """dict AS (SELECT label, row_number() OVER (ORDER BY first_doc, label) - 1 AS code
  FROM (SELECT label, min(doc_id) AS first_doc FROM l1 GROUP BY label))"""
LISTS = """lists AS (SELECT d.doc_id,
    coalesce(list_sort(list(l.label) FILTER (WHERE l.label IS NOT NULL)), []::VARCHAR[]) AS labels
  FROM documents d LEFT JOIN l1 l USING (doc_id) GROUP BY d.doc_id)"""
ENC = """enc AS (SELECT d.doc_id,
    coalesce(list(c.code ORDER BY l.label) FILTER (WHERE l.label IS NOT NULL), []::BIGINT[]) AS codes
  FROM documents d LEFT JOIN l1 l USING (doc_id) LEFT JOIN dict c USING (label) GROUP BY d.doc_id)"""

TOKS = f"""toks AS (SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS word
  FROM (SELECT doc_id, {tokens_of('text')} AS t FROM documents))"""
V1 = """v1 AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 AS idx
  FROM (SELECT word, count(*) AS n FROM toks GROUP BY word HAVING count(*) >= 5))"""
W1 = "w1 AS (SELECT v.word, CAST(e.embedding AS DOUBLE[]) AS vector FROM v1 v JOIN embeddings e ON e.vec_id = v.idx % (SELECT count(*) FROM embeddings))"
DIMS = "dims AS (SELECT unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS dim)"
DOCVEC = """known AS (SELECT t.doc_id, w.vector FROM toks t JOIN w1 w USING (word)),
kl AS (SELECT doc_id, unnest(range(len(vector))) AS dim, unnest(vector) AS v FROM known),
agg AS (SELECT doc_id, dim, avg(v) AS value FROM kl GROUP BY doc_id, dim),
dv AS (SELECT d.doc_id, dims.dim, coalesce(a.value, 0.0) AS x
  FROM documents d CROSS JOIN dims LEFT JOIN agg a ON a.doc_id = d.doc_id AND a.dim = dims.dim)"""
P1 = """el AS (SELECT vec_id, label, unnest(range(len(embedding))) AS dim,
    unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
p1 AS (SELECT label AS unit, dim, avg(x) AS w FROM el GROUP BY label, dim)"""
EMB_SCORES = """sc AS (SELECT el.vec_id, p1.unit, sum(el.x * p1.w) AS s FROM el JOIN p1 USING (dim)
  GROUP BY el.vec_id, p1.unit),
mx AS (SELECT vec_id, unit, s, max(s) OVER (PARTITION BY vec_id) AS m FROM sc),
ex AS (SELECT vec_id, unit, exp(s - m) AS e FROM mx),
pr AS (SELECT vec_id, unit, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM ex),
pred AS (SELECT vec_id, unit AS pred FROM (SELECT vec_id, unit,
    row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, unit) AS rn FROM pr) WHERE rn = 1)"""
DOC_PRED = """dsc AS (SELECT dv.doc_id, p1.unit, sum(dv.x * p1.w) AS s FROM dv JOIN p1 USING (dim)
  GROUP BY dv.doc_id, p1.unit),
dpred AS (SELECT doc_id, unit AS pred FROM (SELECT doc_id, unit,
    row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, unit) AS rn FROM dsc) WHERE rn = 1)"""
SPLICED = (f"sp AS (SELECT doc_id, text || ' [1] [x] [12]b [[3]] [] ' || {NL} || '  ' || {NL} || "
           f"'Category:' || source || ' [' || CAST(doc_id AS VARCHAR) || ']' AS text FROM documents)")
HIST = "h AS (SELECT user_id AS run, event_id AS iteration, value AS loss FROM events)"
BEST = """best AS (SELECT h.run, m.best_loss, min(h.iteration) AS best_iteration, m.n_evals FROM h
  JOIN (SELECT run, min(loss) AS best_loss, count(*) AS n_evals FROM h GROUP BY run) m
    ON h.run = m.run AND h.loss = m.best_loss
  GROUP BY h.run, m.best_loss, m.n_evals)"""
CLEAN_TOKS = f"""ct AS (SELECT doc_id, unnest({tokens_of(clean('text'))}) AS word FROM documents),
cts AS (SELECT * FROM ct WHERE NOT list_contains({STOP_LIST}, word))"""


def _lemma_ctes() -> list[str]:
    """Candidates from the suffix rules over CTE ``words``; ``best`` = the winner."""
    parts = ["SELECT word, 0 AS rule, word AS cand FROM words"]
    for i, (suf, rep) in enumerate(P.NOUN_SUFFIX_RULES, start=1):
        parts.append(f"SELECT word, {i}, left(word, length(word) - {len(suf)}) || {_q(rep)} "
                     f"FROM words WHERE suffix(word, {_q(suf)})")
    cands = "\n  UNION ALL ".join(parts)
    return [
        f"cands AS ({cands})",
        "hits AS (SELECT * FROM cands WHERE length(cand) > 0 AND cand IN (SELECT word FROM words))",
        """best AS (SELECT word, cand AS lemma FROM (SELECT word, cand,
    row_number() OVER (PARTITION BY word ORDER BY length(cand), rule) AS rn FROM hits) WHERE rn = 1)""",
    ]


def _lemma_sql() -> str:
    return with_(
        f"words AS (SELECT DISTINCT w AS word FROM (SELECT unnest({tokens_of('text')}) AS w FROM documents))",
        *_lemma_ctes(),
        TOKS,
    ) + ("SELECT t.doc_id, coalesce(b.lemma, t.word) AS lemma, count(*) AS n FROM toks t LEFT JOIN best b USING (word) "
         "GROUP BY t.doc_id, coalesce(b.lemma, t.word)")


def _lemma_vocabulary_sql() -> str:
    return with_(
        CLEAN_TOKS,
        "words AS (SELECT DISTINCT word FROM cts)",
        *_lemma_ctes(),
        "lem AS (SELECT coalesce(b.lemma, c.word) AS word FROM cts c LEFT JOIN best b USING (word))",
    ) + ("SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 AS idx "
         "FROM (SELECT word, count(*) AS n FROM lem GROUP BY word HAVING count(*) >= 5)")


def _wiki_sql() -> str:
    """The wiki fixture and its rules; the fixture's deepest nesting is known, so
    that many passes over the templates are written out."""
    depth = f"CAST(doc_id % {MAX_DEPTH} + 1 AS BIGINT)"
    c = (f"('== ' || lang || ' ==' || {NL} || '''''''Bold'''''' [[page|' || source || ']] [[plain]] ' || "
         f"repeat('{{{{t|', {depth}) || lang || repeat(' }}}}', {depth}) || '<ref>gone</ref> ' || text)")
    steps = [*[(p, "") for p in P.WIKI_DROP], *[(P.WIKI_TEMPLATE, "")] * MAX_DEPTH, (P.WIKI_TABLE, ""), (P.WIKI_PIPED_LINK, "\\1"),
             (P.WIKI_LINK, "\\1"), (P.WIKI_EXTERNAL_LINK, "\\1"), (P.WIKI_EMPHASIS, ""), (P.WIKI_HEADING, "\\1"), (P.WIKI_TAG, "")]
    for pattern, to in steps:
        c = f"regexp_replace({c}, {_q(pattern)}, '{to}', 'g')"
    return f"SELECT doc_id, {c} AS plain FROM documents"


def _wiki_nested_sql() -> str:
    """The nested fixture: every mark becomes one control character, and innermost
    pairs go pass by pass, as often as the fixture nests them."""
    depth = f"CAST(doc_id % {MAX_DEPTH} + 1 AS BIGINT)"
    c = (f"repeat('{{{{t|', {depth}) || lang || repeat('}}}}', {depth}) || {NL} || "
         f"repeat('{{| out' || {NL} || '| a {{{{cell' || {NL} || '|}}}}' || {NL}, {depth}) || lang || repeat({NL} || '|}}' || {NL}, {depth}) || "
         f"'[[File:x.png|thumb|seen [[page|' || source || ']] here]] caf&eacute; &#233;&#x1F642; &nosuch; &amp;lt; ' || "
         f"CASE WHEN doc_id % 3 = 0 THEN '{{{{left [[open ' ELSE ']] }}}} ' END || "
         f"CASE WHEN doc_id % 5 = 0 THEN {NL} || '{{| open' || {NL} ELSE {NL} || '|}}' || {NL} END || "
         "text || CASE WHEN doc_id % 4 = 0 THEN ' }} ]] ' ELSE '' END")
    for pattern in P.WIKI_DROP:
        c = f"regexp_replace({c}, {_q(pattern)}, '', 'g')"
    c = f"replace(replace({c}, '{{{{', chr(1)), '}}}}', chr(2))"
    for _ in range(MAX_DEPTH + 1):
        c = f"regexp_replace({c}, '\\x01[^\\x01\\x02]*\\x02', '', 'g')"
    c = f"replace(replace({c}, chr(1), '{{{{'), chr(2), '}}}}')"
    c = f"regexp_replace(regexp_replace({c}, '(?m)^\\{{\\|', chr(3), 'g'), '(?m)^\\|\\}}', chr(4), 'g')"
    for _ in range(MAX_DEPTH + 1):
        c = f"regexp_replace({c}, '\\x03[^\\x03\\x04]*\\x04', '', 'g')"
    c = f"replace(replace({c}, chr(3), '{{|'), chr(4), '|}}')"
    for _ in range(3):
        c = f"regexp_replace({c}, {_q(P.WIKI_INNER_LINK)}, '\\1', 'g')"
    for pattern, to in [(P.WIKI_EXTERNAL_LINK, "\\1"), (P.WIKI_EMPHASIS, ""), (P.WIKI_HEADING, "\\1"), (P.WIKI_TAG, "")]:
        c = f"regexp_replace({c}, {_q(pattern)}, '{to}', 'g')"
    for ref, char in [("&eacute;", "chr(233)"), ("&#233;", "chr(233)"), ("&#x1F642;", "chr(128578)"), ("&amp;", "'&'")]:
        c = f"replace({c}, '{ref}', {char})"
    return f"SELECT doc_id, {c} AS plain FROM documents"


def _conv_net_sql() -> str:
    """The net of ``ml_queries.conv_net_weights`` as joins and sums; b of a unit is the
    stored weight of its number."""
    def bias(unit: str) -> str:
        return f"(SELECT x FROM fw WHERE pl = {unit} % (SELECT n FROM nw))"

    def cycled(unit: str, size: str, i: str) -> str:
        return f"({unit} * {size} + {i}) % (SELECT n FROM nw)"
    f1, f2, k, p1, p2, h = NET_FILTERS[0], NET_FILTERS[1], NET_WIDTH, NET_POOLS[0], NET_POOLS[1], NET_HIDDEN
    return with_(
        P1, "wd AS (SELECT max(len(embedding)) AS d FROM embeddings)",
        "fw AS (SELECT unit * (SELECT d FROM wd) + dim AS pl, w AS x FROM p1)", "nw AS (SELECT count(*) AS n FROM fw)",
        f"sz AS (SELECT (d - {k} + 1) // {p1} AS w1, ((d - {k} + 1) // {p1} - {k} + 1) // {p2} AS w2 FROM wd)",
        f"k1 AS (SELECT o, j, x AS w FROM (SELECT unnest(range({f1})) AS o) a CROSS JOIN (SELECT unnest(range({k})) AS j) b "
        f"JOIN fw ON pl = {cycled('o', str(k), 'j')})",
        f"c1 AS (SELECT vec_id, o, i, sum(el.x * k1.w) AS c FROM el, k1, (SELECT unnest(range((SELECT w1 FROM sz) * {p1})) AS i) p "
        f"WHERE el.dim = i + {k - 1} - j GROUP BY vec_id, o, i)",
        f"m1 AS (SELECT vec_id, o, i // {p1} AS q, max(c) AS m FROM c1 GROUP BY ALL)",
        f"b1 AS (SELECT o, {bias('o')} AS b FROM (SELECT unnest(range({f1})) AS o))",
        "a1 AS (SELECT vec_id, m1.o AS m, q, tanh(m1.m + b) AS x FROM m1 JOIN b1 ON m1.o = b1.o)",
        f"k2 AS (SELECT o, m, j, x AS w FROM (SELECT unnest(range({f2})) AS o) a CROSS JOIN (SELECT unnest(range({f1})) AS m) b "
        f"CROSS JOIN (SELECT unnest(range({k})) AS j) c JOIN fw ON pl = {cycled('o', str(f1 * k), f'm * {k} + j')})",
        f"c2 AS (SELECT vec_id, o, a1.q - {k - 1} + j AS i, sum(a1.x * k2.w) AS c FROM a1 JOIN k2 USING (m) "
        f"WHERE a1.q - {k - 1} + j BETWEEN 0 AND (SELECT w2 FROM sz) * {p2} - 1 GROUP BY ALL)",
        f"m2 AS (SELECT vec_id, o, i // {p2} AS q, max(c) AS m FROM c2 GROUP BY ALL)",
        f"b2 AS (SELECT o, {bias('o')} AS b FROM (SELECT unnest(range({f2})) AS o))",
        "a2 AS (SELECT vec_id, m2.o * (SELECT w2 FROM sz) + q AS i, tanh(m2.m + b) AS x FROM m2 JOIN b2 ON m2.o = b2.o)",
        f"kh AS (SELECT u, i, x AS w FROM (SELECT unnest(range({h})) AS u) a CROSS JOIN (SELECT unnest(range({f2} * (SELECT w2 FROM sz))) AS i) b "
        f"JOIN fw ON pl = {cycled('u', f'({f2} * (SELECT w2 FROM sz))', 'i')})",
        f"hid AS (SELECT vec_id, u, tanh(sum(a2.x * kh.w) + any_value({bias('u')})) AS x FROM a2 JOIN kh USING (i) GROUP BY vec_id, u)",
        f"ko AS (SELECT c, u, x AS w FROM (SELECT DISTINCT unit AS c FROM p1) a CROSS JOIN (SELECT unnest(range({h})) AS u) b "
        f"JOIN fw ON pl = {cycled('c', str(h), 'u')})",
        f"sc AS (SELECT vec_id, c, sum(hid.x * ko.w) + any_value({bias('c')}) AS s FROM hid JOIN ko USING (u) GROUP BY vec_id, c)",
    ) + "SELECT vec_id, CAST(c AS BIGINT) AS pred FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) AS r FROM sc) WHERE r = 1"


def _fit_ctes(split: str) -> list[str]:
    """The steps of the penalised softmax fit, written out: w<t> holds the weights of
    step t, e<t> its loss, norms and validation error."""
    out = [P1.split("p1 AS")[0].rstrip().rstrip(","), f"sides AS MATERIALIZED ({split})",
           "units AS MATERIALIZED (SELECT unnest(range((SELECT max(label) + 1 FROM embeddings))) AS unit)",
           "xs AS MATERIALIZED (SELECT el.vec_id, el.label, el.dim, el.x, s.split FROM el JOIN sides s USING (vec_id))",
           "rows_of AS MATERIALIZED (SELECT count(DISTINCT vec_id) FILTER (split = 'train') AS n FROM xs)",
           "w0 AS MATERIALIZED (SELECT unit, dim, 0.0::DOUBLE AS w FROM units CROSS JOIN (SELECT DISTINCT dim FROM xs))",
           "b0 AS MATERIALIZED (SELECT unit, 0.0::DOUBLE AS b FROM units)"]
    for t in range(FIT_STEPS + 1):
        out += [
            f"s{t} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, any_value(split) AS split, unit, sum(x * w) + any_value(b) AS s "
            f"FROM xs JOIN w{t} USING (dim) JOIN b{t} USING (unit) GROUP BY vec_id, unit)",
            f"p{t} AS MATERIALIZED (SELECT vec_id, label, split, unit, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY vec_id) AS p "
            f"FROM (SELECT *, max(s) OVER (PARTITION BY vec_id) AS m FROM s{t}))",
            f"e{t} AS MATERIALIZED (SELECT {t} AS step, (SELECT avg(-ln(p)) FROM p{t} WHERE split = 'train' AND unit = label) + {FIT_L1} * l1 + {FIT_L2} * l2_sq AS loss, "
            f"l1, l2_sq, (SELECT avg((unit <> label)::INT) FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, unit) AS r FROM p{t} "
            f"WHERE split = 'test') WHERE r = 1) AS valid_error FROM (SELECT sum(abs(w)) AS l1, sum(w * w) AS l2_sq FROM w{t}))"]
        if t < FIT_STEPS:
            out += [
                f"d{t} AS MATERIALIZED (SELECT vec_id, unit, (p - (unit = label)::INT) / (SELECT n FROM rows_of) AS d FROM p{t} WHERE split = 'train')",
                f"v{t} AS MATERIALIZED (SELECT unit, dim, w - {FIT_RATE} * (g + 2 * {FIT_L2} * w) AS v FROM w{t} JOIN "
                f"(SELECT unit, dim, sum(d * x) AS g FROM d{t} JOIN xs USING (vec_id) GROUP BY unit, dim) USING (unit, dim))",
                f"w{t + 1} AS MATERIALIZED (SELECT unit, dim, sign(v) * greatest(abs(v) - {FIT_RATE * FIT_L1}, 0) AS w FROM v{t})",
                f"b{t + 1} AS MATERIALIZED (SELECT unit, b - {FIT_RATE} * g AS b FROM b{t} JOIN (SELECT unit, sum(d) AS g FROM d{t} GROUP BY unit) USING (unit))"]
    out.append("hist AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM e{t}" for t in range(FIT_STEPS + 1)) + ")")
    return out


def _ints(expr: str) -> str:
    return f"array_to_string({expr}, ',')"


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    # sources
    q["scan_dump_xml"] = ("SELECT page_id AS id, url AS title, html AS text FROM pages "
                          "WHERE page_id IS NOT NULL AND url IS NOT NULL AND html IS NOT NULL")
    q["scan_id_list"] = ("SELECT DISTINCT doc_id AS id FROM "
                         "(SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels) WHERE doc_id IS NOT NULL")
    q["scan_doc_lines"] = (f"SELECT doc_id, CAST(unnest(range(len(ls))) AS BIGINT) AS line_no, unnest(ls) AS line "
                           f"FROM (SELECT doc_id, string_split(source || {NL} || text, {NL}) AS ls FROM documents)")
    q["scan_documents"] = "SELECT doc_id, source AS title, text FROM documents"
    q["scan_category_tables"] = with_(G1) + (
        "SELECT l.cl_from, l.cl_to, l.cl_type, p.page_title AS from_title "
        "FROM g1_links l JOIN g1_page p ON p.page_id = l.cl_from")
    q["load_artifacts"] = with_(L1, DICT, ENC, TOKS, V1, W1) + (
        f"SELECT 'train_data' AS artifact, CAST(doc_id AS VARCHAR) AS name, {_ints('codes')} AS codes, CAST(NULL AS DOUBLE) AS total FROM enc "
        "UNION ALL SELECT 'category_codes', label, CAST(code AS VARCHAR), NULL FROM dict "
        f"UNION ALL SELECT 'word_vectors', word, NULL, {rnd('list_sum(vector)')} FROM w1")
    # sinks
    q["write_id_list"] = with_(G1, WALK) + f"SELECT page_id AS id FROM ({DESCENT})"
    q["write_documents"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"
    q["write_artifacts"] = with_(L1, DICT) + "SELECT label, code FROM dict"
    q["write_metrics"] = with_(HIST, BEST) + (
        "SELECT run, iteration, 'loss' AS metric, loss AS value FROM h "
        "UNION ALL SELECT run, best_iteration, 'best_loss', best_loss FROM best")
    # projections and filters
    names = " UNION ALL ".join(
        f"SELECT doc_id, {expr} AS file_name FROM documents" for expr in (
            "'id_' || CAST(doc_id AS VARCHAR) || '.txt'", "'id_' || CAST(doc_id AS VARCHAR)",
            "'id_' || CAST(doc_id AS VARCHAR) || '.tar.gz'", "'id_x' || CAST(doc_id AS VARCHAR) || '.txt'"))
    q["doc_id_from_path"] = (f"SELECT doc_id, file_name, CAST(TRY_CAST(regexp_extract(file_name, "
                             f"{_q(P.ID_FROM_FILE_NAME)}, 1) AS BIGINT) AS VARCHAR) AS parsed_id FROM ({names})")
    q["path_from_doc_id"] = "SELECT doc_id, 'id_' || CAST(doc_id AS VARCHAR) || '.txt' AS file_name FROM documents"
    lemmas = _lemma_ctes()
    q["get_doc_by_id"] = with_(
        TOKS, "words AS (SELECT DISTINCT word FROM toks)", *lemmas,
        f"own AS (SELECT * FROM toks WHERE doc_id = 42 AND NOT list_contains({STOP_LIST}, word))",
    ) + ("SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS words, string_agg(coalesce(lemma, word), ' ' ORDER BY pos) AS lemmas "
         "FROM own LEFT JOIN best USING (word) GROUP BY doc_id")
    dims = f"CAST(dim AS BIGINT) AS dim, {rnd('x')} AS value FROM dv"
    q["get_vector_by_id"] = with_(TOKS, V1, W1, DIMS, DOCVEC) + f"SELECT doc_id, {dims} WHERE doc_id = 42"
    q["take_vector_page"] = with_(TOKS, V1, W1, DIMS, DOCVEC) + (
        f"SELECT doc_id, {dims} WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50)")
    q["edge_kind_filter"] = with_(G1) + "SELECT cl_from, cl_to, cl_type FROM g1_links WHERE cl_type = 'page'"
    q["page_level_id"] = ("SELECT page_id AS id, url AS title FROM pages WHERE html IS NOT NULL AND url IS NOT NULL "
                          "AND page_id IN (SELECT doc_id FROM labels)")
    q["drop_incomplete_pages"] = (
        "SELECT d.doc_id, CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic "
        "FROM documents d JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL AND l.quality IS NOT NULL "
        "AND d.doc_id IS NOT NULL")
    q["drop_blank_lines"] = with_(SPLICED) + f"SELECT doc_id, {drop_blank('text')} AS text FROM sp"
    q["remove_stopwords"] = (f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens "
                             f"FROM (SELECT doc_id, list_filter({tokens_of('text')}, "
                             f"lambda w: NOT list_contains({STOP_LIST}, w)) AS t FROM documents)")
    # joins
    q["semi_join_ids"] = "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"
    q["resolve_titles"] = with_(G1) + (
        "SELECT l.cl_from, l.cl_to, p.page_title AS child_title FROM g1_links l "
        "JOIN g1_page p ON p.page_id = l.cl_from WHERE l.cl_type = 'subcat'")
    q["category_members"] = with_(G1, "fr AS (SELECT DISTINCT n_name AS category FROM nation)") + (
        "SELECT f.category, l.cl_from AS member_id, 'page' AS kind, CAST(NULL AS VARCHAR) AS child_title "
        "FROM fr f JOIN g1_links l ON l.cl_to = f.category AND l.cl_type = 'page' "
        "UNION ALL SELECT f.category, l.cl_from, 'subcat', p.page_title "
        "FROM fr f JOIN g1_links l ON l.cl_to = f.category AND l.cl_type = 'subcat' "
        "JOIN g1_page p ON p.page_id = l.cl_from")
    q["labels_by_id"] = with_(L1B, LISTS) + "SELECT doc_id, array_to_string(labels, '|') AS labels FROM lists"
    q["encode_labels"] = with_(L1, DICT, ENC) + f"SELECT doc_id, {_ints('codes')} AS codes FROM enc"
    q["lookup_word_vectors"] = with_(TOKS, V1, W1) + (
        "SELECT t.doc_id, CAST(t.pos AS BIGINT) AS pos, t.word FROM toks t JOIN w1 USING (word)")
    q["attach_label_list"] = with_(TOKS, V1, W1, DIMS, DOCVEC, L1, DICT, ENC) + (
        f"SELECT e.doc_id, {_ints('e.codes')} AS codes, {rnd('s.vsum')} AS vsum FROM enc e "
        "JOIN (SELECT doc_id, sum(x) AS vsum FROM dv GROUP BY doc_id) s USING (doc_id)")
    # graph
    q["category_descent"] = with_(G1, WALK) + DESCENT
    seeds = " UNION ALL ".join(f"SELECT {_q(s)}, 0" for s in PARTIAL_SEEDS)
    q["category_descent_partial"] = with_(G1, WALK.replace("SELECT 'ROOT', 0", f"SELECT * FROM ({seeds})")
                                          .replace("w.lvl < 3", "w.lvl < 1")) + DESCENT
    # aggregations
    q["label_dictionary"] = with_(L1, DICT) + "SELECT label, code FROM dict"
    q["count_labels"] = with_(L1) + "SELECT CAST(count(DISTINCT label) AS BIGINT) AS n_labels FROM l1"
    q["total_words"] = with_(CLEAN_TOKS) + "SELECT CAST(count(*) AS BIGINT) AS total_words FROM cts"
    q["label_list_stats"] = with_(L1B, DICT, ENC) + (
        f"SELECT CAST(sum(len(codes)) AS BIGINT) AS n_samples, CAST(max(len(codes)) AS BIGINT) AS max_len, "
        f"{rnd('avg(len(codes))')} AS mean_len FROM enc")
    q["corpus_counts"] = with_(L1) + (
        "SELECT (SELECT count(*) FROM documents) AS n_documents, "
        "(SELECT count(DISTINCT doc_id) FROM labels) AS n_asked, "
        "(SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) AS n_found, "
        "(SELECT count(DISTINCT doc_id) FROM l1) AS n_labeled, "
        "(SELECT count(DISTINCT label) FROM l1) AS n_categories")
    q["build_vocabulary"] = with_(TOKS, V1) + "SELECT word, n, idx FROM v1"
    q["clean_corpus_vocabulary"] = with_(CLEAN_TOKS) + (
        "SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 AS idx "
        "FROM (SELECT word, count(*) AS n FROM cts GROUP BY word HAVING count(*) >= 5)")
    q["mean_embedding"] = with_(TOKS, V1, W1, DIMS, DOCVEC) + (
        f"SELECT doc_id, CAST(dim AS BIGINT) AS dim, {rnd('x')} AS value FROM dv")
    q["reduce_mean"] = with_(P1, EMB_SCORES) + (
        "SELECT " + rnd("avg(err)") + " AS mean_batch_error FROM (SELECT b, avg(CASE WHEN pred <> label "
        "THEN 1.0 ELSE 0.0 END) AS err FROM (SELECT p.pred, e.label, (row_number() OVER (ORDER BY e.vec_id) - 1) // 20 AS b "
        "FROM embeddings e JOIN pred p USING (vec_id)) GROUP BY b)")
    q["weight_norms"] = with_(P1) + f"SELECT {rnd('sum(abs(w))')} AS l1, {rnd('sum(w * w)')} AS l2_sq FROM p1"
    # windows
    q["best_checkpoint"] = with_(HIST) + (
        "SELECT run, iteration, loss, prev_best, (prev_best IS NULL OR loss < prev_best) AS is_best, "
        "(prev_best IS NOT NULL AND loss < prev_best * 0.995) AS is_significant FROM "
        "(SELECT run, iteration, loss, min(loss) OVER (PARTITION BY run ORDER BY iteration "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best FROM h)")
    q["best_iteration"] = with_(HIST, BEST) + (
        "SELECT run, best_loss, best_iteration, CAST(n_evals AS BIGINT) AS n_evals FROM best")
    # sorts / top-k
    q["argmax_class"] = with_(P1, EMB_SCORES) + "SELECT vec_id, CAST(pred AS BIGINT) AS pred FROM pred"
    q["take_batch"] = "SELECT doc_id, n_chars FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50"
    # set ops
    q["union_distinct_pages"] = with_(G1) + "SELECT DISTINCT cl_from AS page_id FROM g1_links WHERE cl_type = 'page'"
    q["distinct_ids"] = "SELECT DISTINCT l_orderkey AS id FROM lineitem"
    # string scalars
    q["strip_numeric_brackets"] = with_(SPLICED) + f"SELECT doc_id, regexp_replace(text, {_q(R1)}, '\\1', 'g') AS text FROM sp"
    q["strip_category_prefix"] = with_(SPLICED) + "SELECT doc_id, replace(text, 'Category:', '') AS text FROM sp"
    q["clean_document"] = with_(SPLICED) + f"SELECT doc_id, {clean('text')} AS text FROM sp"
    q["tokenize"] = (f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens "
                     f"FROM (SELECT doc_id, {tokens_of('text')} AS t FROM documents)")
    q["lemmatize_nouns"] = _lemma_sql()
    q["lemma_corpus_vocabulary"] = _lemma_vocabulary_sql()
    q["markup_to_plain"] = f"SELECT page_id, {html_plain('html')} AS plain FROM pages"
    q["compose_document"] = f"SELECT p_partkey, concat_ws({NL}, p_name, p_type) AS doc FROM part"
    q["decode_bytes"] = (f"SELECT doc_id, decode(encode(text)) AS utf8, "
                         f"regexp_replace(text, {_q(P.NON_ASCII)}, '', 'g') AS ascii FROM documents")
    # arrays / math
    q["pad_label_list"] = with_(L1B, DICT, ENC, "m AS (SELECT max(len(codes)) AS m FROM enc)") + (
        "SELECT doc_id, array_to_string(list_concat(codes, list_transform(range(m.m - len(codes)), "
        "lambda i: -1)), ',') AS padded FROM enc CROSS JOIN m")
    q["dense_layer"] = with_(P1, "sc AS (SELECT el.vec_id, p1.unit, sum(el.x * p1.w) AS s FROM el JOIN p1 USING (dim) "
                             "GROUP BY el.vec_id, p1.unit)") + (
        f"SELECT vec_id, CAST(unit AS BIGINT) AS unit, {rnd('tanh(s)')} AS value FROM sc")
    q["zero_one_multilabel_error"] = with_(P1, EMB_SCORES) + (
        f"SELECT {rnd('avg(CASE WHEN p.pred = e.label THEN 0.0 ELSE 1.0 END)')} AS error "
        "FROM embeddings e JOIN pred p USING (vec_id)")
    q["softmax"] = with_(P1, EMB_SCORES) + f"SELECT vec_id, CAST(unit AS BIGINT) AS unit, {rnd('p')} AS value FROM pr"
    q["mean_nll"] = with_(P1, EMB_SCORES) + (
        f"SELECT {rnd('avg(-ln(pr.p))')} AS nll FROM pr JOIN embeddings e ON e.vec_id = pr.vec_id AND pr.unit = e.label")
    q["conv_pool_1d"] = with_(
        P1,
        "wd AS (SELECT max(len(embedding)) AS n, max(len(embedding)) // 4 AS k FROM embeddings)",
        "f AS (SELECT unit * 4 + dim // k AS filter, dim % k AS j, w FROM p1, wd WHERE dim < 4 * k)",
        "pos AS (SELECT unnest(range((SELECT n - k + 1 FROM wd))) AS i)",
        "conv AS (SELECT el.vec_id, f.filter, pos.i, sum(el.x * f.w) AS c FROM pos CROSS JOIN f "
        "JOIN el ON el.dim = pos.i + ((SELECT k FROM wd) - 1 - f.j) GROUP BY el.vec_id, f.filter, pos.i)",
        "pool AS (SELECT vec_id, filter, i // 4 AS q, max(c) AS m FROM conv "
        "WHERE i // 4 < (SELECT n - k + 1 FROM wd) // 4 GROUP BY vec_id, filter, i // 4)",
    ) + f"SELECT vec_id, CAST(filter AS BIGINT) AS filter, CAST(q AS BIGINT) AS pos, {rnd('tanh(m)')} AS value FROM pool"
    q["score_conv_net"] = _conv_net_sql()
    q["batch_count"] = ("SELECT CAST(b AS BIGINT) AS batch_size, "
                        "CAST(ceil((SELECT count(*) FROM documents) / b) AS BIGINT) AS n_batches "
                        "FROM (VALUES (6), (20), (500)) t(b)")
    # data flow
    q["explode_pairs"] = with_(L1B, DICT, ENC) + (
        "SELECT doc_id, CAST(unnest(range(len(codes))) AS BIGINT) AS pos, CAST(unnest(codes) AS BIGINT) AS code FROM enc")
    q["assign_batches"] = with_(
        L1, DICT, ENC,
        "pairs AS (SELECT doc_id, unnest(range(len(codes))) AS pos, unnest(codes) AS code FROM enc)",
        "ix AS (SELECT doc_id, pos, code, row_number() OVER (ORDER BY doc_id, pos) - 1 AS idx FROM pairs)",
    ) + "SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(code AS BIGINT) AS code, idx, idx // 6 AS batch_id FROM ix"
    q["assemble_batches"] = with_(
        TOKS, V1, W1, DIMS, DOCVEC, L1, DICT, ENC, "most AS (SELECT max(len(codes)) AS m FROM enc)",
        "pairs AS (SELECT doc_id, unnest(range(len(codes))) AS pos, unnest(codes) AS code FROM enc)",
        f"ix AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) - 1 AS idx FROM pairs)",
        f"bt AS (SELECT *, idx // {P.LOGISTIC_BATCH} AS batch_id, idx % {P.LOGISTIC_BATCH} + 1 AS r FROM ix)",
        "wx AS (SELECT doc_id, sum(x * (dim + 1)) AS s FROM dv GROUP BY doc_id)",
        "padded AS (SELECT doc_id, array_to_string(list_concat(codes, list_transform(range(m - len(codes)), lambda i: -1)), ',') AS p FROM enc, most)",
    ) + (f"SELECT batch_id, count(*) AS n_rows, {rnd('sum(s * r)')} AS features, string_agg(code, ',' ORDER BY r) AS labels, "
         "string_agg(p, '|' ORDER BY r) AS label_lists FROM bt JOIN wx USING (doc_id) JOIN padded USING (doc_id) GROUP BY batch_id")
    q["train_test_split"] = (
        "SELECT doc_id, CASE WHEN ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 10 < 8 "
        "THEN 'train' ELSE 'test' END AS split FROM documents")
    q["predict"] = with_(TOKS, V1, W1, DIMS, DOCVEC, P1, DOC_PRED) + "SELECT doc_id, CAST(pred AS BIGINT) AS pred FROM dpred"
    q["evaluate_model"] = with_(TOKS, V1, W1, DIMS, DOCVEC, P1, DOC_PRED, L1, DICT, ENC,
                                "j AS (SELECT e.doc_id, e.codes, p.pred, CASE WHEN list_contains(e.codes, p.pred) "
                                "THEN 0.0 ELSE 1.0 END AS miss, CAST(len(e.codes) AS DOUBLE) AS n "
                                "FROM enc e JOIN dpred p USING (doc_id) WHERE len(e.codes) > 0)") + (
        f"SELECT {rnd('sum(miss * n) / sum(n)')} AS pair_error, {rnd('avg(miss)')} AS doc_error, "
        "CAST(sum(n) AS BIGINT) AS n_pairs, CAST(count(*) AS BIGINT) AS n_docs FROM j")
    q["train_word_vectors"] = with_(TOKS, V1) + (
        f"SELECT CAST(count(*) AS BIGINT) AS n_words, CAST({P.W2V_VECTOR_SIZE} AS BIGINT) AS dims, true AS vocabulary_matches FROM v1")
    q["train_logistic"] = ("SELECT CAST(max(label) + 1 AS BIGINT) AS n_classes, CAST(max(len(embedding)) AS BIGINT) AS n_features, "
                           "true AS below_prior_loss FROM embeddings")
    q["train_mlp"] = (f"SELECT CAST(max(len(embedding)) AS BIGINT) AS n_inputs, CAST({P.MLP_HIDDEN} AS BIGINT) AS n_hidden, "
                      "CAST(max(label) + 1 AS BIGINT) AS n_classes, true AS better_than_chance FROM embeddings")
    fit = _fit_ctes(q["train_test_split"].replace("doc_id", "vec_id").replace("FROM documents", "FROM embeddings"))
    q["fit_history"] = with_(*fit) + (f"SELECT CAST(step AS BIGINT) AS step, {rnd('loss')} AS loss, {rnd('l1')} AS l1, {rnd('l2_sq')} AS l2_sq, "
                                      f"{rnd('valid_error')} AS valid_error FROM hist")
    q["best_validation_model"] = with_(
        *fit, "best AS (SELECT step FROM hist ORDER BY valid_error, step LIMIT 1)",
        "ws AS (" + " UNION ALL ".join(f"SELECT {t} AS step, * FROM w{t}" for t in range(FIT_STEPS + 1)) + ")",
    ) + f"SELECT CAST(step AS BIGINT) AS step, CAST(unit AS BIGINT) AS unit, CAST(dim AS BIGINT) AS dim, {rnd('w')} AS w FROM ws JOIN best USING (step)"
    q["flow_lemma_tokens"] = with_(
        CLEAN_TOKS, "words AS (SELECT DISTINCT word FROM cts)", *_lemma_ctes(),
        "lem AS (SELECT c.doc_id, coalesce(b.lemma, c.word) AS word FROM cts c LEFT JOIN best b USING (word))",
    ) + "SELECT doc_id, word, count(*) AS n FROM lem GROUP BY doc_id, word"
    q["flow_train_evaluate"] = with_(
        L1, DICT, ENC, f"sides AS ({q['train_test_split']})",
        "used AS (SELECT s.split, len(e.codes) AS n FROM enc e JOIN sides s USING (doc_id))",
    ) + ("SELECT count(*) FILTER (split = 'train') AS n_train_docs, CAST(sum(n) FILTER (split = 'train') AS BIGINT) AS n_train_pairs, "
         "count(*) FILTER (split = 'test' AND n > 0) AS n_test_docs, CAST(sum(n) FILTER (split = 'test') AS BIGINT) AS n_test_pairs, "
         "true AS loss_fell, true AS error_is_a_share FROM used")
    q["wiki_to_plain"] = _wiki_sql()
    q["wiki_nested_to_plain"] = _wiki_nested_sql()
    q["pipeline_model"] = f"SELECT doc_id, CAST({PIPELINE_DIMS} AS BIGINT) AS dims, true AS same_vector, true AS same_class FROM documents"
    q["save_model"] = "SELECT vec_id, true AS same_prediction FROM embeddings"
    q["vectorizer_plugin"] = with_(
        f"st AS (SELECT doc_id, w AS word FROM (SELECT doc_id, unnest({tokens_of('text')}) AS w FROM documents) "
        f"WHERE NOT list_contains({STOP_LIST}, w))",
        "tf AS (SELECT doc_id, word, count(*) AS tf FROM st GROUP BY doc_id, word)",
        "nd AS (SELECT count(DISTINCT doc_id) AS n FROM documents)",
        "dfq AS (SELECT word, count(*) AS df FROM tf GROUP BY word)",
    ) + (f"SELECT tf.doc_id, tf.word, CAST(tf.tf AS BIGINT) AS tf, "
         f"{rnd('tf.tf * ln((nd.n + 1.0) / (dfq.df + 1.0))')} AS tfidf FROM tf JOIN dfq USING (word) CROSS JOIN nd")
    return q
