"""Main text of web pages: the contiguous region whose words and tags score highest.

A page is a sequence of words and tags.  Words score by the elements they are in, tags
cost; the weights of tag names and of the words in class, id and role names are log-odds
counted on labelled pages.  What the weights call boilerplate (the innermost element that
says something decides) scores nothing and is never taken, so an advert inside the article
does not cut it in two.  One linear scan finds the region of the largest sum, and its
blocks are the text.

The labelled pages are written out below, as page layouts with the content marked; other
labelled pages can be counted in the same way (``counted``), also as a table.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetmatch.llm.store import fresh, others, table

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
GONE = RAW | frozenset("head template svg math object canvas audio video map select button datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
HEAD = frozenset("head meta link base title style script noscript template".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd".split())
SPACE = frozenset("br td th wbr img".split())  # inside a block, but a gap between words
#: Start tags that end an open element: what is closed, and what it may not be looked for beyond.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}),
}
FENCE = frozenset("table td th caption".split())  # an end tag does not look beyond these
ROWS = frozenset("table caption thead tbody tfoot tr td th".split())  # but those of tables do

# Names that pages give their parts, for the labelled pages.
CONTENT_NAMES = "article content main post entry story body text maincontent articlebody postcontent entrycontent hentry".split()
OTHER_NAMES = (
    "nav navbar navigation menu submenu topbar breadcrumb breadcrumbs pagination pager toc skip header masthead banner branding logo hero footer copyright legal colophon contentinfo"
    " sidebar aside widget widgets rail complementary related recommended recommendations trending popular teaser teasers promo promotion promoted share sharing social follow"
    " ad ads adv advert adverts advertisement advertising adsbygoogle adslot sponsor sponsored sponsors outbrain taboola cookie cookies consent gdpr privacy notice notices alert popup modal"
    " dialog overlay paywall newsletter subscribe subscription signup login register search form feedback survey poll comment comments disqus reply replies respond discussion reviews"
).split()

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|/[^a-zA-Z>][^>]*>|/>|/?[a-zA-Z][^>]*\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
ENOUGH = 0.5  # what an element must weigh to decide
SHORT = 10  # words of a block outside prose that do not count for it
FOUND, SAID, CONTENT_MARK, OTHER_MARK = 1.0, 0.25, "<!--content-->", "<!--/content-->"


def features(tag: str, attributes: str, in_article: bool) -> tuple[str, ...]:
    """What an element is known by: its tag and its names; headers and footers of an article are apart, without the name that says so again."""
    own = in_article and tag in ("header", "footer")
    names = [n.lower() for m in ATTRIBUTE.finditer(attributes) for n in NAME.findall(m[2] or m[3] or m[4] or "")] if "=" in attributes else []
    return (f"{tag}@article" if own else tag, *["." + n for n in names if not (own and n == tag)])


class Element:
    __slots__ = ("known_by", "up", "prose", "kinds")

    def __init__(self, known_by: tuple[str, ...], up: Element | None) -> None:
        self.known_by, self.up, self.kinds = known_by, up, {}
        self.prose = known_by[0] in PROSE or (up is not None and up.prose)


class Chunk(NamedTuple):
    block: int
    text: str
    inside: Element | None  # the innermost open element
    tags: int  # since the chunk before
    linked: bool
    marked: bool  # of labelled pages: between the marks


def chunks(source: str) -> list[Chunk]:
    """A page read once: pieces of text in order, with the element they are in; work and memory are linear in the page."""
    out: list[Chunk] = []
    open_: list[tuple[str, Element]] = []
    names: Counter[str] = Counter()
    block, tags, at, marked, n = 0, 0, 0, False, len(source)

    def close(first: int, last: int | None = None) -> None:
        for name, _ in open_[first:last]:
            names[name] -= 1
            names["#gone"] -= name in GONE
        del open_[first:last]

    def add(text: str) -> None:
        nonlocal tags
        if text and not names["#gone"]:
            out.append(Chunk(block, html.unescape(text) if "&" in text else text, open_[-1][1] if open_ else None, tags, names["a"] > 0, marked))
            tags = 0

    while at < n:
        start = source.find("<", at)
        m = TAG.match(source, start) if start >= 0 else None
        while start >= 0 and m is None:  # a bare "<" is text
            start = source.find("<", start + 1)
            m = TAG.match(source, start) if start >= 0 else None
        add(source[at : start if start >= 0 else n])
        if m is None:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            marked = m[0] == CONTENT_MARK if m[0] in (CONTENT_MARK, OTHER_MARK) else marked
            continue
        tags += 1
        block += name in BLOCK
        if name in SPACE:
            add(" ")
        if open_ and open_[-1][0] == "head" and name not in HEAD:
            close(len(open_) - 1)
        if m[1] or m[4]:
            k = len(open_) - 1 if names[name] else -1
            while k >= 0 and open_[k][0] != name:
                k = -1 if open_[k][0] in FENCE and name not in ROWS else k - 1
            if k >= 0:  # blocks outlive what they should lie in
                close(k, k + 1 if name not in BLOCK and any(o[0] in BLOCK for o in open_[k + 1 :]) else None)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if name in VOID or name in ("html", "body"):
            continue
        if name == "a" and names["a"]:  # a link ends the one before
            k = next(k for k in reversed(range(len(open_))) if open_[k][0] == "a")
            close(k, k + 1)
        ends, fence = ENDS.get(name) or (({"p"}, {"table", "td", "th", "caption"}) if name in BLOCK and name not in ROWS else (None, None))
        if ends and any(names[e] for e in ends):
            k, first = len(open_) - 1, None
            while k >= 0 and open_[k][0] not in fence:
                first = k if open_[k][0] in ends else first
                k = k - 1 if name == "tr" or first is None else -1
            if first is not None:
                close(first)
        attributes = (m[3] if m[2] else m[6]) or ""
        open_.append((name, Element(features(name, attributes, names["article"] > 0), open_[-1][1] if open_ else None)))
        names[name] += 1
        names["#gone"] += name in GONE
    return out


def labelled_pages() -> list[str]:
    """Page layouts with the content between marks: each name of either list occurs alone, in a compound and in other elements."""
    say = lambda k: " ".join("w" for _ in range(3 + k % 3))
    body = lambda k: f"<h1>{say(k)}</h1><p>{say(k)} <a>w</a> <b>w</b></p><ul><li>{say(k)}</li></ul><table><tr><td>{say(k)}</td></tr></table><blockquote>{say(k)}</blockquote><h2>{say(k)}</h2><p>{say(k)}</p>"
    marked = lambda k: f"{CONTENT_MARK}{body(k)}{OTHER_MARK}"
    out = []
    for k, name in enumerate(OTHER_NAMES):
        near = CONTENT_NAMES[k % len(CONTENT_NAMES)]
        plain = f'<div class="{name}"><p>{say(k)}</p><ul><li><a>{say(k)}</a></li></ul><div>{say(k)}</div></div><section id="{near}-{name}"><h3>{say(k)}</h3>{say(k)}</section>'
        inner = f'<div class="{name}"><p>{say(k)}</p></div>'
        chrome = f"<header><h1>{say(k)}</h1></header><nav><ul><li><a>{say(k)}</a></li></ul></nav>"
        tail = f"<aside><h3>{say(k)}</h3><p>{say(k)}</p></aside><form><label>{say(k)}</label><p>{say(k)}</p></form><footer><p>{say(k)}</p></footer>"
        replies = f'<section class="comments"><article class="comment"><p>{say(k)}</p></article></section>'
        out += [
            f"{chrome}{plain}<article>{CONTENT_MARK}<header><h1>{say(k)}</h1></header>{OTHER_MARK}{marked(k)}{inner}{marked(k)}<footer>{say(k)}</footer></article>{replies}{tail}",
            f"{chrome}{plain}<main>{marked(k)}{inner}{marked(k)}</main>{tail}",
            f'{chrome}<div class="{near}">{marked(k)}{inner}{marked(k)}</div>{plain}{tail}',
            f'{chrome}{plain}<section id="{near}">{marked(k)}</section>{replies}{tail}',
        ]
    return out


def counted(pages: Iterable[str]) -> dict[str, tuple[int, int]]:
    """Words under each feature inside and outside the marked content of ``pages``; under "" of all."""
    counts: dict[str, list[int]] = {"": [0, 0]}
    for source in pages:
        for chunk in chunks(source):
            n, under, element = len(chunk.text.split()), {""}, chunk.inside
            while element is not None:
                under.update(element.known_by)
                element = element.up
            for f in under:
                counts.setdefault(f, [0, 0])[0 if chunk.marked else 1] += n
    return {f: (a, b) for f, (a, b) in counts.items()}


def weighed(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log-odds of content for each feature against all words; tags that content uses as others do weigh nothing."""
    all_in, all_out = counts[""]
    out = {f: math.log((a + FOUND) / (all_in + FOUND)) - math.log((b + FOUND) / (all_out + FOUND)) for f, (a, b) in counts.items() if f}
    telling = ("article", "main", "nav", "aside", "form", "header", "footer", "header@article", "footer@article", "search", "menu", "dialog")
    return {f: w for f, w in out.items() if f.startswith(".") or f in telling}


@lru_cache(1)
def built_in() -> dict[str, float]:
    return weighed(counted(labelled_pages()))


class Scorer:
    """Decides what elements are, by weights, and remembers what it decided."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights, self.seen = weights, {}
        self.parts = [f for f in weights if f[0] == "." and len(f) > 5]

    def _weight(self, f: str) -> float:
        """Weight of a feature; an unknown name counts as the least of the known names (of five letters) it begins or ends with."""
        if f in self.weights or f[0] != ".":
            return self.weights.get(f, 0.0)
        ends = [".nav", ".menu"]
        return min((self.weights[k] for k in (*self.parts, *ends) if k in self.weights and (f.endswith(k[1:]) or (k not in ends and f.startswith(k)))), default=0.0)

    def element(self, known_by: tuple[str, ...]) -> float:
        if known_by not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[known_by] = sum(self._weight(f) for f in set(known_by))
        return self.seen[known_by]

    def decided(self, element: Element | None, but: str = "") -> int:
        """1 for content, -1 for boilerplate, 0 where no element says enough; elements of the tag ``but`` say nothing."""
        way, kind = [], 0
        while element is not None and but not in element.kinds:
            way.append(element)
            element = element.up
        if element is not None:
            kind = element.kinds[but]
        for e in reversed(way):
            w = self.element(e.known_by)
            if abs(w) >= ENOUGH and e.known_by[0] != but:
                kind = 1 if w > 0 else -1
            e.kinds[but] = kind
        return kind


def region(page: list[Chunk], kinds: list[int]) -> tuple[int, int]:
    """First and last chunk of the region of the largest sum, by one scan; (0, -1) if no word scores.

    Words of content score FOUND.  On a page that has such words the others cost as much;
    on a page without (or with fewer than a tenth of what lies in prose) words score FOUND
    in prose and in long blocks, and cost it in links and in short blocks.  A tag costs
    SAID.
    """
    words = [len(c.text.split()) for c in page]
    marked = sum(w for w, k in zip(words, kinds, strict=True) if k > 0)
    bare = sum(w for w, k, c in zip(words, kinds, page, strict=True) if k == 0 and c.inside is not None and c.inside.prose and not c.linked)
    use_marks = marked * 10 > bare
    length: Counter[int] = Counter()
    for n, c in zip(words, page, strict=True):
        length[c.block] += n
    best, span, here, first, cost = 0.0, (0, -1), 0.0, 0, 0.0
    for i, (n, kind, c) in enumerate(zip(words, kinds, page, strict=True)):
        if kind < 0:
            continue  # boilerplate and its tags are passed over
        cost += SAID * c.tags
        if not n:
            continue
        if use_marks:
            counts = kind > 0
        else:
            counts = not c.linked and (length[c.block] >= SHORT or (c.inside is not None and c.inside.prose))
        if here <= cost:
            here, first, cost = 0.0, i, 0.0
        here, cost = here - cost + (FOUND * n if counts else -FOUND * n), 0.0
        if here > best:
            best, span = here, (first, i)
    return span


def main_text(source: str | None, scorer: Scorer) -> str:
    """Blocks of the best region, white space as one space, a line each; empty if there is none."""
    page = chunks(source or "")
    for but in ("", "form"):  # pages that are one large form
        kinds = [scorer.decided(c.inside, but) for c in page]
        first, last = region(page, kinds)
        if last >= first:
            break
    blocks: dict[int, list[str]] = {}
    for c, kind in zip(page[first : last + 1], kinds[first : last + 1], strict=True):
        if kind >= 0:
            blocks.setdefault(c.block, []).append(c.text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extracted(pages: DataFrame, column: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (its code points) from the whole of ``column``.

    Null and empty pages, and pages without content, have the empty text; repeated rows
    have the same.  Columns of the added names (in any case) are replaced, other columns
    stay as they are; an empty table gives an empty one.  ``weights`` are those of
    ``weighed``; by default of the built-in labelled pages.
    """
    known = weights or built_in()
    out = fresh(pages, "_main")

    @F.pandas_udf("string")
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(known)
        for part in parts:
            yield pd.Series([main_text(source, scorer) for source in part], dtype=object)

    kept = others(pages, ["text", "n_chars"])
    rows = pages.withColumn(out, texts(F.col(f"`{column}`")))
    return rows.select(*[F.col(f"`{c}`") for c in kept], F.col(out).alias("text"), F.char_length(out).cast("long").alias("n_chars"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
