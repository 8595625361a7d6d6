"""Column expressions for text: all JVM-side, no Python UDFs."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- file names --------------------------------------------------------------

def doc_id_from_file_name(name) -> Column:
    """``id_<id>.<ext>`` -> id as LONG; null when the part is not a number."""
    return F.regexp_extract(_col(name), P.ID_FROM_FILE_NAME, 1).try_cast("long")


def file_name_from_doc_id(doc_id) -> Column:
    return F.concat(F.lit(P.DOC_FILE_PREFIX), _col(doc_id).cast("string"),
                    F.lit(P.DOC_FILE_SUFFIX))


# -- cleaning ----------------------------------------------------------------

def split_lines(text) -> Column:
    return F.split(_col(text), "\n")


def drop_blank_lines(text) -> Column:
    """Remove lines made only of white space; the other lines keep their order."""
    kept = F.filter(split_lines(text), lambda line: ~line.rlike(P.BLANK_LINE))
    return F.array_join(kept, "\n")


def strip_category_prefix(text) -> Column:
    return F.replace(_col(text), F.lit(P.CATEGORY_PREFIX), F.lit(""))


def strip_numeric_brackets(text) -> Column:
    """Delete ``[digits]`` marks; other bracketed runs are put back."""
    return F.regexp_replace(_col(text), P.NUMERIC_BRACKETS, "$1")


def clean_document(text) -> Column:
    """Blank lines out, then the category prefix, then citation marks.

    The two replacements never cross a newline, so running them over the
    re-joined document equals running them line by line.
    """
    return strip_numeric_brackets(strip_category_prefix(drop_blank_lines(text)))


def tokenize(text) -> Column:
    """Lower-cased Unicode word runs, in document order, repeats kept."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(P.WORD_RUN), F.lit(0))


def remove_stopwords(tokens, stop_words=None) -> Column:
    """Drop stop words from a token array; duplicates of other words stay."""
    stop = list(P.ENGLISH_STOP_WORDS if stop_words is None else stop_words)
    return F.filter(_col(tokens), lambda t: ~t.isin(stop))


def compose_document(title, text) -> Column:
    """Title, newline, body."""
    return F.concat_ws("\n", _col(title), _col(text))


def split_title(value) -> Column:
    """Inverse of :func:`compose_document`: struct(title, text)."""
    v = _col(value)
    pos = F.instr(v, "\n")
    return F.struct(
        F.when(pos > 0, F.substring(v, F.lit(1), pos - 1)).otherwise(v).alias("title"),
        F.when(pos > 0, F.substring(v, pos + 1, F.length(v))).otherwise(F.lit("")).alias("text"),
    )


def decode_utf8(raw) -> Column:
    return F.decode(_col(raw), "UTF-8")


def ascii_only(text) -> Column:
    """Drop every non-ASCII character (the lossy ASCII decode)."""
    return F.regexp_replace(_col(text), P.NON_ASCII, "")


# -- markup ------------------------------------------------------------------

def nesting(text: Column, pattern: str = P.WIKI_TEMPLATE_MARK, opening: str = "{{") -> Column:
    """Deepest nesting of the marks that ``pattern`` finds in a text (null: 0)."""
    marks = F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a, mark):
        now = F.when(mark == opening, a["now"] + 1).otherwise(F.greatest(a["now"] - 1, F.lit(0)))
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))
    return F.aggregate(marks, start, step, lambda a: a["most"])


def wiki_to_plain(text) -> Column:
    c = _col(text)
    for pat in P.WIKI_DROP:
        c = F.regexp_replace(c, pat, "")
    # innermost templates go first: as many passes as this text nests them deep
    c = F.aggregate(F.sequence(F.lit(0), nesting(c)), c,
                    lambda t, i: F.when(i > 0, F.regexp_replace(t, P.WIKI_TEMPLATE, "")).otherwise(t))
    c = F.regexp_replace(c, P.WIKI_TABLE, "")
    c = F.regexp_replace(c, P.WIKI_PIPED_LINK, "$1")
    return wiki_inline(F.regexp_replace(c, P.WIKI_LINK, "$1"))


def wiki_inline(text) -> Column:
    """External links to their text; emphasis, heading marks and tags out."""
    c = F.regexp_replace(_col(text), P.WIKI_EXTERNAL_LINK, "$1")
    c = F.regexp_replace(c, P.WIKI_EMPHASIS, "")
    c = F.regexp_replace(c, P.WIKI_HEADING, "$1")
    return F.regexp_replace(c, P.WIKI_TAG, "")


def decode_references(text) -> Column:
    """Character references to their characters: decimal, hexadecimal and all
    named ones that end in a semicolon. Each is decoded once; unknown names stay,
    numbers of no character become U+FFFD."""
    c = _col(text)
    names = F.from_json(F.lit(json.dumps({f"&{k}": v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")

    def char(ref: Column) -> Column:
        code = F.when(ref.rlike("^&#[xX]"), F.conv(F.regexp_extract(ref, "[xX]([0-9a-fA-F]+)", 1), 16, 10)).otherwise(
            F.regexp_extract(ref, "&#([0-9]+)", 1)).try_cast("long")
        bad = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
        known = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, 0xFFFD).otherwise(code)), 8, "0")), "UTF-32")
        return F.when(ref.startswith("&#"), known).otherwise(F.coalesce(F.element_at(names, ref), ref))

    refs = F.transform(F.regexp_extract_all(c, F.lit(P.CHARACTER_REFERENCE), F.lit(0)), char)
    parts = F.zip_with(F.split(c, P.CHARACTER_REFERENCE), refs, lambda part, ref: F.concat(part, F.coalesce(ref, F.lit(""))))
    return F.when(F.contains(c, F.lit("&")), F.array_join(parts, "")).otherwise(c)


def html_to_plain(html) -> Column:
    c = _col(html)
    for pat in P.HTML_DROP:
        c = F.regexp_replace(c, pat, "")
    c = F.regexp_replace(c, P.HTML_TAG, " ")
    for ent, ch in P.HTML_ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return F.trim(F.regexp_replace(c, P.HTML_SPACE_RUN, " "))
