"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from . import pii as P
from . import quality as Q
from . import topk as T
from . import warc as W

_WORD = "[^\\x20\\x09-\\x0D]+"

_MEASURES = rf"""
docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
worded AS (SELECT rid, regexp_extract_all(text, '{_WORD}') AS ws FROM docs),
words AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos, len(ws) AS n FROM worded),
wins AS (SELECT rid, pos, CASE WHEN pos + {Q.WINDOW - 1} <= n THEN array_to_string(list(w) OVER (
           PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND {Q.WINDOW - 1} FOLLOWING), ' ') END AS win FROM words),
flagged AS (SELECT rid, pos, win IS NOT NULL AND count(win) OVER (PARTITION BY rid, win) > 1 AS again FROM wins),
covered AS (SELECT rid, bool_or(again) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN {Q.WINDOW - 1} PRECEDING AND CURRENT ROW) AS c
            FROM flagged),
repeated AS (SELECT rid, count(*) FILTER (c) AS n_repeat_words FROM covered GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM docs),
measured AS (
  SELECT d.doc_id, d.source, len(v.ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(v.ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l.ls) - len(list_distinct(l.ls)))::BIGINT AS n_dup_lines,
         coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l.ls)::BIGINT AS n_lines
  FROM docs d JOIN worded v USING (rid) JOIN lines l USING (rid) LEFT JOIN repeated r USING (rid)),
tested AS (
  SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM measured),
failed AS (
  SELECT *, base_failed OR 100 * n_symbols > {Q.MAX_SYMBOL_PERCENT} * n_words
         OR 100 * n_dup_lines > {Q.MAX_DUP_LINE_PERCENT} * n_lines OR word_chars > {Q.MAX_WORD_CHARS} * n_words AS failed FROM tested),
hosts AS (SELECT source, count(*) AS n, sum(failed::INT) AS f FROM failed WHERE source IS NOT NULL GROUP BY source),
moments AS (SELECT count(*) AS h, sum(n) AS docs, sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ** 2 AS b FROM hosts),
prior AS (SELECT m, CASE WHEN m * (1 - m) <= 0 OR b <= m * (1 - m) * h / docs THEN {Q.MAX_PRIOR}
            ELSE least({Q.MAX_PRIOR}, greatest(1, (m * (1 - m) - b) / (b - m * (1 - m) * h / docs))) END AS k FROM moments),
verdicts AS (SELECT source, (m * k + f) / (k + n) >= {Q.MAX_HOST_RATE} AS rejected FROM hosts, prior)
"""

OP4 = f"""WITH {_MEASURES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM failed LEFT JOIN verdicts USING (source)
"""

OP8 = f"""
WITH flat AS (SELECT vec_id, list_transform(embedding, lambda x: floor({T.SCALE} * x::DOUBLE)::BIGINT) AS v, row_number() OVER () AS rid
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM flat q JOIN flat c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {T.QUERY_EVERY} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::INT AS rank, vec_id, score FROM ranked WHERE r <= {T.TOP}
"""

OP9 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {W.MIN_SHARED_BYTES} AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {W.MIN_SHARED_BYTES} AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""

#: The patterns as the contract writes them; RE2 needs no help to stay linear.
_PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "tel": r"\+[0-9][\x20().0-9-]+[0-9]|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"}
_DIGITS = "regexp_replace(s, '[^0-9]', '', 'g')"
_ACCOUNT = "replace(s, ' ', '')"
_TURNED = f"(substr({_ACCOUNT}, 5) || substr({_ACCOUNT}, 1, 4))"
_PII_CHECKS = {
    "email": "true",
    "ip": "len(list_filter(string_split(s, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (CASE WHEN ltrim(x, '0') = '' OR length(ltrim(x, '0')) > 3 "
          "THEN 0 ELSE ltrim(x, '0')::INT END) > 255)) = 0",
    "card": f"length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(list_reverse(string_split({_DIGITS}, '')), lambda x, i: "
            "CASE WHEN i % 2 = 1 THEN x::INT ELSE 2 * x::INT - 9 * (x::INT > 4)::INT END)) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": "NOT regexp_matches(bef, '[A-Za-z0-9]$') AND NOT regexp_matches(aft, '^[A-Za-z0-9]') AND list_reduce(list_prepend(0::BIGINT, "
            f"list_transform(string_split({_TURNED}, ''), lambda x: (CASE WHEN ascii(x) < 65 THEN ascii(x) - 48 ELSE ascii(x) - 55 END)::BIGINT)), "
            "lambda a, x: (a * (CASE WHEN x < 10 THEN 10 ELSE 100 END) + x) % 97) = 1",
    "ssn": "NOT regexp_matches(bef, '[0-9-]$') AND NOT regexp_matches(aft, '^[0-9-]') AND left(s, 3) NOT IN ('000', '666') AND left(s, 1) <> '9' "
           "AND substr(s, 5, 2) <> '00' AND right(s, 4) <> '0000'",
    "tel": "NOT regexp_matches(bef, '[0-9A-Za-z.+-]$') AND NOT regexp_matches(aft, '^[0-9A-Za-z-]') AND left(s, 1) <> '+'"}


def _pii_kind(kind: str) -> str:
    w, pattern = P.WEIGHTS[kind], _PII_PATTERNS[kind].replace("'", "''")
    said = "regexp_matches(lower(bef || ' ' || aft), '(?:^|[^a-z])(?:{})(?:[^a-z]|$)')"
    score = f"{w.prior} + CASE WHEN {said.format(w.near)} THEN {w.gain} ELSE 0 END"
    if w.against:
        score += f" - CASE WHEN {said.format(w.against)} THEN {w.loss} ELSE 0 END"
    kept = "m"
    if kind == "iban":
        sizes = " ".join(f"WHEN left(m, 2) IN ({', '.join(repr(c) for c in cs.split())}) THEN {n - 1}" for n, cs in P.IBAN_LENGTHS.items())
        kept = f"nullif(regexp_extract(m, '^[A-Z0-9](?: ?[A-Z0-9]){{' || (CASE {sizes} ELSE 99 END) || '}}'), '')"
    least = "true" if kind in P.BASE_KINDS else f"score >= {P.MIN_SCORE}"
    return f"""
{kind}_cut AS (SELECT rid, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gs FROM docs),
{kind}_rows AS (SELECT rid, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i, unnest(gs[1:len(ms)]) AS g, unnest(gs[2:len(ms) + 1]) AS g2 FROM {kind}_cut),
{kind}_at AS (SELECT *, sum(length(g) + length(m)) OVER w - length(m) AS b,
  right(coalesce(right(lag(g) OVER w, {P.CONTEXT}) || lag(m) OVER w, '') || g, {P.CONTEXT}) AS bef, {kept} AS s
  FROM {kind}_rows WINDOW w AS (PARTITION BY rid ORDER BY i)),
{kind}_near AS (SELECT rid, b, s, bef, left(substr(m, length(s) + 1) || g2, {P.CONTEXT}) AS aft FROM {kind}_at WHERE s IS NOT NULL),
{kind}_spans AS (SELECT * FROM (SELECT rid, b, {P.KINDS.index(kind)} AS ord, b + length(s) AS e, '{kind}' AS kind, {score} AS score FROM {kind}_near
  WHERE {_PII_CHECKS[kind]}) WHERE {least})"""


OP12 = f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
{','.join(_pii_kind(k) for k in P.KINDS)},
spans AS ({' UNION ALL '.join(f'SELECT * FROM {k}_spans' for k in P.KINDS)}),
found AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in P.BASE_KINDS)},
  string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord) FILTER (ord < {len(P.BASE_KINDS)}) AS base,
  string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, ord) AS spans, count(*) FILTER (ord >= {len(P.BASE_KINDS)}) AS n_added,
  string_agg(format('{{:.2f}}', score::DOUBLE), ',' ORDER BY b, ord) AS scores FROM spans GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in P.BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_added, 0) AS n_added, coalesce(scores, '') AS scores FROM docs LEFT JOIN found USING (rid)
"""


def sql() -> dict[str, str]:
    return {"op4_quality_rules": OP4, "op8_exact_top_k": OP8, "op9_warc": OP9, "op12_pii": OP12}
