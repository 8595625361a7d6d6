"""Main text of HTML pages by the maximum-scoring subsequence.

A page is read as a sequence of words and tags. Words score positive or negative
by the element they stand in, tags score negative; the weights come from labelled
pages, that is pages whose markup says where the article is. On every page these
weights alone are summed, its own article markup has no part in them. One linear
scan finds the best contiguous region, whose words are the main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

SAMPLE_PAGES = 2000  # labelled pages that the weights are counted from
CLIP = 4.0  # largest weight
WORD, TAG = 2.0, -0.2  # weights of a word or tag in elements that the labelled pages lack
LEFT_OUT, LINK = "-", "a"  # keys of the words in left-out elements (with the tag of the outermost) and in links
LEAST_SHARE = 0.5  # of a page's words in its marked element for the page to be a label

WRAPPER_SHARE = 0.9  # of a page's words in an element that is then not left out for its attributes

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = frozenset("script style title textarea noscript template iframe svg math object canvas xmp noembed noframes".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span "
                    "strike strong sub sup time tt u var wbr".split())
_OUT_TAGS = frozenset("head nav footer aside form menu dialog button select option fieldset audio video".split())
_HARD = frozenset("nav aside footer head dialog menu".split())  # an article inside these is a teaser
_HARD_WORDS = frozenset("comment comments disqus promo recommended related replies respond teaser".split())  # or a reader's comment
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_OUT_WORDS = frozenset("ad ads adbox advert adverts advertisement advertising adsbygoogle banner breadcrumb breadcrumbs comment comments "
                       "consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices "
                       "outbrain overlay pager pagination popup promo promotion recommended related replies respond search share sharing "
                       "sidebar signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar topbar widget widgets".split())
_BOX_WORDS = frozenset("area articles bar block blocks bottom box button buttons col column container content desktop fixed form global group header "
                       "icons inner item items js left line link links list main mobile outer panel posts primary right row secondary section "
                       "site slot sticky top unit wrap wrapper".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSED_BY = {"p": frozenset("p address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol "
                             "pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]),
              "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
              "tr": frozenset(["tr"]), "option": frozenset(["option"])}


def _left_out(name: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is no main text: by its tag, and by its attributes; and
    whether articles inside it are none either."""
    by_tag, hard = name in _OUT_TAGS, name in _HARD
    if not attributes or name in ("html", "body"):
        return by_tag, False, hard
    words: set[str] = set()
    by_attribute = False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            words.update(*(_named_for(token) for token in value.split()))
        elif key == "role" and value in _OUT_ROLES or key == "hidden" or key == "aria-hidden" and value == "true" \
                or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            by_attribute = True
    if name in ("article", "main"):  # a wide element named after its parts; a reader's comment is an article, too
        return False, by_attribute or bool({"comment", "teaser", "related", "ad", "promo"} & words), False
    by_attribute = by_attribute or bool(_OUT_WORDS & words) or name not in _HEADINGS and "header" in words
    return by_tag, by_attribute, hard or bool(_HARD_WORDS & words)


def _named_for(token: str) -> set[str]:
    """The words a class token or id stands for: its parts, if each is such a word or
    says only where or in what box it stands. has-sidebar or related-work name
    something else."""
    parts = [x for x in re.split(r"[^a-z0-9]+", token) if x and not x.isdigit()]
    return set(parts) if all(x in _OUT_WORDS or x in _BOX_WORDS for x in parts) else set()


class _Open(NamedTuple):
    """An open element, with what holds for text in it."""
    name: str
    out: bool  # left out
    container: int  # 2 in an article, 1 in a main element, else 0
    hard: bool  # articles inside are no main text either
    block: str  # name and place of the nearest element that is not inline
    block_at: int
    link: bool
    header: int  # 1 in a header, 2 in a heading of a header
    outermost: str  # name of the outermost element that is left out
    by_tag: bool  # left out whatever the attributes say
    number: int  # of an element left out by its attributes, else -1
    words: int  # of the page before it


_NOTHING = _Open("", False, 0, False, "", -1, False, 0, "", False, -1, 0)


class Page:
    """The sequence of one page. ``items``: (kind, key, text, number of words,
    left out, container): kind "w" for text and "t" for a tag; container is 2 in
    an article, 1 in a main element, else 0. ``marked`` counts the outermost
    elements of these kinds that are not left out.

    An element that would be left out for its attributes but holds nearly all of the page's
    words is a wrapper of the page and stays, unless it is named for comments or teasers. Each open element carries what its text
    needs, so the time is in proportion to the page however deep its elements stand.
    """

    def __init__(self, source: str, use_attributes: bool = True):
        wrappers: frozenset[int] = frozenset()
        for _ in range(2):
            self.items: list[tuple] = []
            self.marked: Counter = Counter()
            found = self._read(source, use_attributes, wrappers)
            if not found:
                break
            wrappers = found

    def _read(self, source: str, use_attributes: bool, wrappers: frozenset[int]) -> frozenset[int]:
        """Fills ``items``; the numbers of the elements that turn out to be wrappers,
        none if ``wrappers`` are given."""
        stack, opened = [_NOTHING], Counter()
        inside: list[int] = []
        self._words, at = 0, 0

        def close(i: int) -> None:
            for x in stack[i:]:
                opened[x.name] -= 1
                if x.number >= 0:
                    inside[x.number] = self._words - x.words
            del stack[i:]

        for m in _markup(source):
            if m.start() > at:
                self._text(source[at:m.start()], stack[-1])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:  # end tag
                if opened[name]:
                    close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
                if name not in _INLINE:
                    self.items.append(("t", None, "", 0, False, 0))
                continue
            if name in _VOID or name in _RAW:
                if name not in _INLINE:
                    self.items.append(("t", name, "", 0, False, stack[-1].container))
                continue
            while name in _CLOSED_BY.get(stack[-1].block, ()):
                close(stack[-1].block_at)
            up = stack[-1]
            by_tag, by_attribute, by_hard = _left_out(name, m[3] or m[6] or "")
            number = -1
            if by_attribute and use_attributes and not by_tag and not by_hard:
                number = len(inside)
                inside.append(0)
                by_attribute = number not in wrappers
            mine = by_tag or use_attributes and by_attribute
            out, container, hard = up.out, up.container, up.hard or mine and by_hard
            if name in ("article", "main"):
                if out and not mine and not hard and not container:
                    out = False  # an element left open before the article, or one round the whole page
                kind = 0 if mine or out else 2 if name == "article" else 1
                self.marked[kind] += kind > container
                container = max(container, kind)
            if name == "header":
                mine = mine or not container
            inline = name in _INLINE
            header = 2 if up.header and name in _HEADINGS else up.header or int(name == "header")
            stack.append(_Open(name, out or mine, container, hard, up.block if inline else name, up.block_at if inline else len(stack), up.link or name == LINK,
                               header, up.outermost or (name if out or mine else ""), up.by_tag or by_tag, number, self._words))
            opened[name] += 1
            if not inline:
                self.items.append(("t", name, "", 0, out or mine, container))
        if at < len(source):
            self._text(source[at:], stack[-1])
        close(1)
        return frozenset() if wrappers else frozenset(i for i, n in enumerate(inside) if n and n >= WRAPPER_SHARE * self._words)

    def _text(self, raw: str, here: _Open) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        out, n = here.out or here.header == 1, len(text.split())  # of an article's header only the headings stay
        key = LEFT_OUT + (here.outermost or "header") if out else LINK if here.link else here.block
        self.items.append(("w", key, text, n, out, here.container))
        if not here.by_tag:
            self._words += n

    def label(self) -> int:
        """The kind of marked element that says where the main text is: the only
        one of its kind, with most of the page's words; 0 if there is none. One
        teaser beside the text, or a list of articles, says nothing."""
        words: Counter = Counter()
        for kind, _, _, n, out, c in self.items:
            if kind == "w" and not out:
                words[c] += n
        for kind in (2, 1):
            inside = sum(n for c, n in words.items() if c >= kind)
            if inside and self.marked[kind] == 1 and inside >= LEAST_SHARE * words.total():
                return kind
        return 0


def _markup(source: str):
    """Markup in page order; the content of raw elements belongs to their tag."""
    at = 0
    while m := _MARKUP.search(source, at):
        yield m
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if name in _RAW and not (m[1] or m[4]) and not m[0].endswith("/>"):
            end = _RAW_END[name].search(source, at)
            yield _Skip(at, end.start() if end else len(source))
            at = end.start() if end else len(source)


class _Skip:
    """A stretch without text, in the shape of a match."""

    def __init__(self, start: int, end: int):
        self._span = start, end

    def start(self) -> int:
        return self._span[0]

    def end(self) -> int:
        return self._span[1]

    def __getitem__(self, group: int) -> str:
        return ""


def learn_weights(sources: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words by element and of tags, from pages whose article or main
    element is a label: log odds of standing inside it, smoothed and clipped."""
    words: dict[bool, Counter] = {True: Counter(), False: Counter()}
    tags: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for source in sources:
        page = Page(source)
        inner = page.label()
        if not inner:
            continue
        for kind, key, _, n, out, container in page.items:
            if kind == "w":
                words[container >= inner][key] += n
            elif key and not out:
                tags[container >= inner][key] += 1
    odds = lambda c, k: float(np.clip(np.log((c[True][k] + 1) / (c[False][k] + 1)), -CLIP, CLIP))
    return ({k: odds(words, k) for k in sorted({*words[True], *words[False]})},
            {k: min(-0.2, odds(tags, k)) for k in sorted({*tags[True], *tags[False]})})


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the largest sum; of equal ones the first
    and shortest; (0, 0) if no sum is above zero."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(source: str | None, words: dict[str, float], tags: dict[str, float]) -> str:
    """The main text of one whole page; empty if there is none.

    Every word and tag scores by the learned weights, whether it stands in marked
    elements or not. Character references are decoded, white space inside a block
    and between blocks becomes one space. If everything is left out because of
    class names or the like, these are ignored."""
    if not source:
        return ""
    for use_attributes in (True, False):
        page = Page(source, use_attributes)
        scores = []
        for kind, key, _, n, out, _ in page.items:
            if kind == "w" and out:  # never part of the text; it only parts regions, however long it is
                scores.append(min(0.0, words.get(key, -CLIP)) / CLIP)
            elif kind == "w":
                scores.append(n * words.get(key, -WORD if key == LINK else WORD))
            else:
                scores.append(0.0 if key is None else tags.get(key, TAG))
        a, b = best_region(scores)
        parts = [" " if kind == "t" else "" if out else text for kind, _, text, _, out, _ in page.items[a:b]]
        text = " ".join("".join(parts).split())
        if text:
            return text
    return ""


def learn(pages: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """The weights from the first ``SAMPLE_PAGES`` pages by a hash of their id
    that have an article or main element."""
    rows = pages.select("page_id", F.col("html").cast("string").alias("html")).where("page_id is not null")
    rows = rows.where(F.lower("html").rlike("<(article|main)[\\s>]"))
    ids = rows.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES)
    return learn_weights([r.html for r in rows.join(ids, "page_id", "left_semi").orderBy("page_id", "html").limit(2 * SAMPLE_PAGES).collect()])


def text_column(source: Column, words: dict[str, float], tags: dict[str, float]) -> Column:
    @arrow_udf("string")
    def extracted(sources: pa.Array) -> pa.Array:
        return pa.array([main_text(s, words, tags) for s in sources.to_pylist()], pa.string())
    return extracted(source.cast("string"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages -> (page_id, url, text, n_chars), one row per input row. A null or
    empty page, or one without main text, has an empty text. Repeated rows are
    extracted each time; an empty table gives an empty table; other columns are
    not looked at."""
    return (pages.select("page_id", "url", text_column(F.col("html"), *learn(pages)).alias("text"))
            .withColumn("n_chars", F.length("text").cast("bigint")))
