"""Personal data in texts: patterns propose spans, checksums and number rules
confirm them, words nearby move the score.

Everything is a Spark expression on the row of the document: no Python worker, no
shuffle. A span's place is the running sum of the lengths of the pieces between the
matches of its pattern, so no text is searched from its start twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "tel")
KINDS = BASE_KINDS + ADDED_KINDS
CONTEXT = 40  # code points looked at on either side
MIN_SCORE = 0.5  # of the added kinds; the base kinds always stay

# Patterns. A run is entered only at its start or where the last match ended, and
# repeats that cannot give anything back are possessive: time is linear in the text.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    # numbers with a plus are taken along so that no part of one is proposed
    "tel": r"\+[0-9][\x20().0-9-]+[0-9]|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
}
#: A character without which the pattern cannot match; all but email also need a digit.
_NEEDED = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
_CARD_LIKE = r"[0-9](?:[\x20-]?[0-9]){11}"

# Lengths of the account numbers by country, as published.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "LC MT", 32: "SC", 33: "RU"}
_OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
_SSN = r"^(?:00[1-9]|0[1-9][0-9]|[1-578][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])-(?:0[1-9]|[1-9][0-9])-(?:000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3})$"


@dataclass(frozen=True)
class Weights:
    """Score of a confirmed span, what words nearby add, and what they take off."""
    prior: float
    near: str
    gain: float
    against: str = ""
    loss: float = 0.0


WEIGHTS = {
    "email": Weights(0.8, "e-?mail|mail|contact|write|reply", 0.15),
    "ip": Weights(0.6, "ip|address|host|server|client|login|from", 0.2, "version|release|section|chapter|build", 0.3),
    "card": Weights(0.7, "card|visa|mastercard|amex|credit|debit|payment|paid", 0.25, "isbn|order|tracking|serial|sku|imei", 0.3),
    "phone": Weights(0.7, "phone|tel|telephone|call|mobile|cell|fax|whatsapp|contact", 0.2),
    "iban": Weights(0.8, "iban|account|bank|transfer|payee", 0.15),
    "ssn": Weights(0.4, "ssn|social security|social-security|taxpayer", 0.4, "order|part|model|invoice|serial", 0.2),
    "tel": Weights(0.4, "phone|tel|telephone|call|mobile|cell|fax|whatsapp|contact", 0.3, "order|part|model|invoice|serial", 0.2),
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(lengths: Column) -> Column:
    """Inclusive running sums of an int array: sums of pieces of about root(n)
    entries first, then inside each piece, so that no list is copied n times."""
    none = F.array().cast("array<int>")

    def scan(values: Column, start: Column, inclusive: bool) -> Column:
        begin = F.struct(start.alias("now"), none.alias("out"))

        def step(a: Column, x: Column) -> Column:
            after = a["now"] + x
            return F.struct(after.alias("now"), F.concat(a["out"], F.array(after if inclusive else a["now"])).alias("out"))
        return F.aggregate(values, begin, step, lambda a: a["out"])

    def whole(a: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(a))).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int")), lambda i: F.slice(a, i * size + 1, size))

        def joined(parts: Column) -> Column:
            totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda x, y: x + y))
            return F.flatten(F.zip_with(parts, scan(totals, F.lit(0), False), lambda p, b: scan(p, b, True)))
        return F.when(F.size(a) == 0, none).otherwise(_let(pieces, joined))
    return _let(lengths, whole)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Weighted digit sum divisible by ten."""
    return F.call_function("luhn_check", digits)


def mod97(account: Column) -> Column:
    """Remainder by 97 of an account number, its first four characters put last
    and letters read as 10 to 35; 1 if its check digits are right."""
    turned = F.concat(F.substring(account, 5, 99), F.substring(account, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97).cast("int")
    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), step)


def _cut_iban(found: Column) -> Column:
    """The account number at the start of a match, by its country's length; null if
    there is none."""
    length = F.lit(None).cast("int")
    for size, countries in IBAN_LENGTHS.items():
        length = F.when(F.substring(found, 1, 2).isin(countries.split()), F.lit(size)).otherwise(length)
    return F.regexp_substr(found, F.concat(F.lit("^[A-Z0-9](?: ?[A-Z0-9]){"), (length - 1).cast("string"), F.lit("}")))


def _kept(kind: str, found: Column) -> Column:
    """What stays of a match: itself, or its beginning; null if nothing."""
    return _cut_iban(found) if kind == "iban" else found


def _confirmed(kind: str, s: Column, before: Column, after: Column) -> Column:
    """Checksums, number ranges and the characters next to a span."""
    if kind == "ip":
        return s.rlike(_OCTETS)
    if kind == "card":
        return F.length(_digits(s)).between(12, 19) & luhn(_digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    if kind == "iban":
        return ~before.rlike("[A-Za-z0-9]$") & ~after.rlike("^[A-Za-z0-9]") & (mod97(F.replace(s, F.lit(" "), F.lit(""))) == 1)
    if kind == "ssn":
        return ~before.rlike("[0-9-]$") & ~after.rlike("^[0-9-]") & s.rlike(_SSN)
    if kind == "tel":
        return ~before.rlike("[0-9A-Za-z.+-]$") & ~after.rlike("^[0-9A-Za-z-]") & ~s.startswith("+")
    return F.lit(True)


def _score(kind: str, before: Column, after: Column) -> Column:
    w = WEIGHTS[kind]
    around = F.lower(F.concat(before, F.lit(" "), after))

    def said(words: str) -> Column:
        return around.rlike(f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)")
    score = F.lit(w.prior) + F.when(said(w.near), w.gain).otherwise(0.0)
    return score - F.when(said(w.against), w.loss).otherwise(0.0) if w.against else score


_FINDING = "array<struct<start:int,at:int,end:int,kind:string,text:string,score:double>>"


def _spans(text: Column, has_digit: Column, kind: str) -> Column:
    """Findings of one kind: leftmost matches that do not overlap, confirmed."""
    pattern = _PATTERNS[kind]

    def place(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            # gaps[i] stands before match i, gaps[i + 1] after it
            steps = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))

            def with_ends(ends: Column) -> Column:
                def one(m: Column, i: Column) -> Column:
                    earlier = F.when(i > 0, F.concat(F.right(F.get(gaps, i - 1), F.lit(CONTEXT)), F.get(found, i - 1))).otherwise("")
                    before = F.right(F.concat(earlier, F.get(gaps, i)), F.lit(CONTEXT))

                    def kept(s: Column) -> Column:
                        after = F.left(F.concat(F.substring(m, F.length(s) + 1, F.length(m)), F.get(gaps, i + 1)), F.lit(CONTEXT))
                        start = F.get(ends, i) - F.length(m)
                        row = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("at"), (start + F.length(s)).alias("end"),
                                       F.lit(kind).alias("kind"), s.alias("text"), F.round(_score(kind, before, after), 3).alias("score"))
                        return F.when(s.isNotNull() & _confirmed(kind, s, before, after), row)
                    return _let(_kept(kind, m), kept)
                rows = F.filter(F.transform(found, one), lambda r: r.isNotNull())
                return rows if kind in BASE_KINDS else F.filter(rows, lambda r: r["score"] >= MIN_SCORE)
            return _let(running_sums(steps), with_ends)
        return F.when(F.size(found) == 0, F.array().cast(_FINDING)).otherwise(_let(F.split(text, pattern, -1), with_gaps).cast(_FINDING))
    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)
    possible = F.lit(True) if kind == "email" else has_digit
    if kind in _NEEDED:
        possible = possible & (F.instr(text, _NEEDED[kind]) > 0)
    if kind == "card":
        possible = possible & text.rlike(_CARD_LIKE)
    return F.when(possible, found).otherwise(F.array().cast(_FINDING))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, findings): every row of ``docs`` with its findings by start, then kind.

    A finding has start and end (code points, end exclusive), kind, text and score.
    email, ip, card and phone are the leftmost matches of their patterns that pass
    their check (four parts up to 255; 12 to 19 digits by Luhn; 9 to 15 digits); their
    score only informs. iban (mod-97 and its country's length), ssn (issued ranges) and
    tel (numbers of ten digits without a country code) need ``MIN_SCORE``, so ssn and
    tel are found only beside words that speak for them. Context is up to ``CONTEXT``
    code points on either side, on the left over one earlier candidate of the kind.

    A null text is an empty one, a null id stays, repeated rows give their findings
    each, an empty table gives none; other columns are not read. Texts of any length
    take time in proportion (running sums: n to the power 1.5 in matches of a text).
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), text.rlike("[0-9]").alias("has_digit"))
    found = F.array_sort(F.concat(*[_spans(F.col("text"), F.col("has_digit"), k) for k in KINDS]))
    return rows.select("doc_id", found.alias("findings"))


def pii_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, scores):
    :func:`find_pii` as counts and as kind:start:end lists, comma-joined; scores of
    all spans in the same order."""
    found = find_pii(docs)
    place = lambda r: F.concat_ws(":", r["kind"], r["start"].cast("string"), r["end"].cast("string"))
    base = F.filter("findings", lambda r: r["at"] < len(BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda r: r["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(F.array_join(F.transform(base, place), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("findings", place), ",").alias("spans"),
        F.size(F.filter("findings", lambda r: r["at"] >= len(BASE_KINDS))).cast("long").alias("n_added"),
        F.array_join(F.transform("findings", lambda r: F.format_string("%.2f", r["score"])), ",").alias("scores"))
