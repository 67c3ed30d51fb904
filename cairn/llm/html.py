"""Main text of HTML pages by boosted trees over DOM nodes.

A page becomes a tree of elements, leniently: unclosed and stray tags are put
right as browsers do for the common cases, comments and what is never shown
(scripts, styles, drawings, choices of a form) are left out, and blocks that are nothing but a button's label.
Text that stands in for what a reader can't show (noscript, iframe, canvas, video) is text. Text that stands in the page
or its body, in no other block, gets an element of its own. Each element gets
statistics: its tag's kind, what the tokens of its class, id and role speak for
(log-odds learned from labelled pages; a token that none of them has speaks for nothing), text and link
density of its subtree and of the text around it, depth, and where it stands among its siblings. Gradient-boosted trees give the
odds that it holds main text. Decoding is hierarchical: the likeliest labelling
of the tree in which nothing below a dropped element is kept, found from the
leaves up.

The trees learn from invented pages of many layouts, made here from a seed, so
no page of the corpus takes part in training. ``python -m cairn.llm.html`` fits
them and writes MODEL, the file that ``trees`` reads. Null or empty html has no text.
Character references are decoded, white space inside a block (line breaks, too)
becomes one space, blocks are trimmed and joined by a blank line in page order.
Pages of any length are read whole, in time linear in their length. Repeated rows each get a row. Of
the kept columns, one named text or n_chars gives way to the new one; other
columns are neither read nor changed.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from cairn.llm import gbt
from cairn.llm.common import with_columns

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content isn't markup, and never shown.
RAW = frozenset("script style textarea title".split())
#: What they hold isn't shown, if they have an end.
HIDDEN = frozenset("template svg select datalist desc metadata".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre section summary table caption thead tbody tfoot tr td th ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags that a start tag may end, and the tags that part them from it.
SCOPES = (
    (("p",), frozenset("table td th caption object body html article section div".split())),
    (("li",), frozenset("ul ol menu".split())),
    (("dt", "dd"), frozenset(("dl",))),
    (("tr", "td", "th"), frozenset(("table",))),
    (("td", "th"), frozenset(("tr", "table"))),
    (("thead", "tbody", "tr", "td", "th"), frozenset(("table",))),
)
#: The scope (a place in SCOPES) whose elements a start tag ends. Every block ends an open p.
ENDS = {"li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "tbody": 5, "tfoot": 5}
#: A tag in its usual form; possessive, so that what it can't read costs one look at it. Any other goes the long way.
_PLAIN = re.compile(r"""<(/?+)([a-zA-Z][^\s/><]*+)((?:\s++[\w:.-]++(?:=(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>=`]++))?+)*+)\s*+(/?+)>""")
_NAME, _GAP, _KEY, _IS, _BARE = (re.compile(x) for x in (r"[a-zA-Z][^\s/>]*+", r"[\s/]*+", r"[^\s/>][^\s/>=]*+", r"\s*+=\s*+", r"[^\s>]*+"))
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)=(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_SPLIT = re.compile(r"[a-z]+")

_KINDS = {
    "nav": 1, "menu": 1, "aside": 2, "footer": 3, "header": 4, "form": 5, "fieldset": 5, "dialog": 5, "article": 10, "main": 10, "section": 9, "body": 8, "html": 8, "div": 7,
    "loose": 11, "p": 12, "blockquote": 12, "pre": 12, "h1": 13, "h2": 14, "h3": 14, "h4": 14, "h5": 14, "h6": 14, "ul": 15, "ol": 15, "dl": 15, "li": 16, "dt": 16, "dd": 16,
    "table": 17, "thead": 17, "tbody": 17, "tr": 17, "td": 18, "th": 18, "figure": 19, "figcaption": 19, "details": 7, "address": 6,
}
FEATURES = (
    "kind", "tokens_for", "tokens_against", "for_above", "against_above", "kind_above", "log_chars", "log_own", "link_share", "density", "depth", "place",
    "log_siblings", "same_tag", "words_a_block", "sentence_ends", "share_of_page", "headings", "paragraphs", "landmarks_above", "share_above", "links_around", "log_above", "share_of_largest", "ends_around",
)
TREES, DEPTH, PAGES, SEED = 120, 5, 4_000, 3
#: Pages that a token must be on for its odds to count.
LEAST = 4
MODEL = Path(__file__).with_name("html_model.json")


class Page:
    """Elements in page order; element 0 is the page."""

    __slots__ = ("tag", "parent", "tokens", "own", "links", "block_of", "texts")

    def __init__(self):
        self.tag, self.parent = ["html"], [-1]
        self.tokens: list[list[str]] = [[]]
        #: For each element: characters directly in it and its inline elements, and those of links.
        self.own, self.links = [0], [0]
        #: Blocks of text: their element, and their text.
        self.block_of: list[int] = []
        self.texts: list[str] = []

    def add(self, tag: str, parent: int, attributes: str = "") -> int:
        found = [t for m in _ATTRIBUTE.finditer(attributes) for t in _SPLIT.findall((m[1] or m[2] or m[3] or "").lower())] if "=" in attributes else []
        self.tag.append(tag), self.parent.append(parent), self.tokens.append(found), self.own.append(0), self.links.append(0)
        return len(self.tag) - 1


class Parser:
    """Block elements become nodes; inline elements only say whether text is of a link."""

    def __init__(self, html: str):
        self.html, self.page = html, Page()
        #: Open elements: tag, node, and for each of SCOPES where its outermost element stands in this list (-1: none).
        self.stack: list[tuple[str, int, tuple[int, ...]]] = [("html", 0, (-1,) * len(SCOPES))]
        self.open: dict[str, list[int]] = {"html": [0]}
        self.blocks = [0]
        self.pieces: list[str] = []
        self.chars = self.link_chars = self.label_chars = self.hidden = 0
        self.last_end: dict[str, int] = {}
        self.no_more: set[str] = set()

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            self.pieces.clear()
            if text and self.chars > self.label_chars:
                page, (tag, node, _) = self.page, self.stack[self.blocks[-1]]
                if tag in ("html", "body"):
                    node = page.add("loose", node)
                page.own[node] += self.chars
                page.links[node] += self.link_chars
                page.block_of.append(node)
                page.texts.append(text)
        self.chars = self.link_chars = self.label_chars = 0

    def text(self, raw: str) -> None:
        if raw and not self.hidden:
            shown = unescape(raw) if "&" in raw else raw
            self.pieces.append(shown)
            if not shown.isspace():
                self.chars += len(shown)
                self.link_chars += len(shown) if self.open.get("a") else 0
                self.label_chars += len(shown) if self.open.get("button") else 0

    def push(self, tag: str, node: int) -> None:
        at, scopes = len(self.stack), self.stack[-1][2]
        if tag in BLOCK:
            scopes = tuple(-1 if tag in walls else at if tag in these and was < 0 else was for (these, walls), was in zip(SCOPES, scopes, strict=True))
            self.blocks.append(at)
        self.hidden += tag in HIDDEN
        self.open.setdefault(tag, []).append(at)
        self.stack.append((tag, node, scopes))

    def pop_to(self, at: int) -> None:
        if self.blocks[-1] >= at:
            self.flush()
        while len(self.stack) > at:
            tag = self.stack.pop()[0]
            self.open[tag].pop()
            self.hidden -= tag in HIDDEN
        while self.blocks[-1] >= at:
            self.blocks.pop()

    def has_end(self, tag: str, at: int) -> bool:
        """Does an end tag of this name follow? One look through the page for each name."""
        if tag not in self.last_end:
            self.last_end[tag] = max((m.start() for m in re.finditer(rf"</{tag}(?=[\s/>])", self.html, re.I)), default=-1)
        return self.last_end[tag] >= at

    def end_tag(self, tag: str) -> None:
        where = self.open.get(tag)
        if not where or where[-1] == 0:
            if tag == "p":
                self.flush()
        elif tag in BLOCK or tag == "a" or where[-1] > self.blocks[-1]:
            self.pop_to(where[-1])

    def start_tag(self, tag: str, attributes: str, closed: bool) -> None:
        if tag == "br":
            self.text(" ")
        elif tag == "hr":
            self.flush()
        elif tag in VOID or tag == "html" or (tag == "body" and self.open.get("body")):
            pass
        elif tag in BLOCK:
            for scope in (0, ENDS.get(tag, 0)):
                if (at := self.stack[-1][2][scope]) > 0:
                    self.pop_to(at)
            self.flush()
            self.push(tag, self.page.add(tag, self.stack[self.blocks[-1]][1], attributes))
        elif not ((tag in HIDDEN or tag == "button") and (closed or not self.has_end(tag, self.at))):
            self.push(tag, self.stack[-1][1])

    def long_way(self, at: int) -> tuple[str, str, bool, int]:
        """Name, attributes (in usual form), whether it ends in a slash, and where what follows begins, of a tag at ``at``; -1 if it has no end."""
        html, end = self.html, len(self.html)
        name = _NAME.match(html, at)
        at, found = name.end(), []
        while True:
            gap = _GAP.match(html, at)
            at = gap.end()
            if at >= end:
                return name[0], "", False, -1
            if html[at] == ">":
                return name[0], " ".join(found), gap[0].endswith("/"), at + 1
            key = _KEY.match(html, at)
            at, value = key.end(), ""
            if is_ := _IS.match(html, at):
                at, quote = is_.end(), html[is_.end() : is_.end() + 1]
                close = html.find(quote, at + 1) if quote in ('"', "'") and quote not in self.no_more else -1
                if close >= 0:
                    at, value = close + 1, html[at + 1 : close]
                else:
                    if quote in ('"', "'"):
                        self.no_more.add(quote)
                    value = _BARE.match(html, at)[0]
                    at += len(value)
            if key[0].lower() in ("class", "id", "role"):
                found.append(f'{key[0]}="{value.replace(chr(34), "")}"')

    def run(self) -> Page:
        html, end, self.at = self.html, len(self.html), 0
        while self.at < end:
            start = html.find("<", self.at)
            if start < 0:
                self.text(html[self.at :])
                break
            self.text(html[self.at : start])
            after = html[start + 1 : start + 3]
            if after[:1].isascii() and after[:1].isalpha() or after[:1] == "/" and after[1:].isascii() and after[1:].isalpha():
                if m := _PLAIN.match(html, start):
                    ends, name, attributes, closed, self.at = bool(m[1]), m[2], m[3], bool(m[4]), m.end()
                else:
                    ends = after[0] == "/"
                    name, attributes, closed, self.at = self.long_way(start + 1 + ends)
                if self.at < 0:
                    break
                tag = name.lower()
                if ends:
                    self.end_tag(tag)
                elif tag in RAW:
                    if not self.has_end(tag, self.at):
                        break
                    self.at = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, self.at).end()
                    close = html.find(">", self.at)
                    self.at = close + 1 if close >= 0 else end
                else:
                    self.start_tag(tag, attributes, closed)
            elif html.startswith("!--", start + 1):
                close = html.find("-->", start + 2)
                self.at = close + 3 if close >= 0 else end
            elif after[:1] in ("!", "?") or (after[:1] == "/" and len(after) == 2):
                close = html.find(">", start + 1)
                self.at = close + 1 if close >= 0 else end
            else:
                self.text("<")
                self.at = start + 1
        self.flush()
        return self.page


def parse(html: str | None) -> Page:
    return Parser(html or "").run()


def features(page: Page, odds: dict[str, float]) -> np.ndarray:
    n = len(page.tag)
    parent = page.parent
    chars, links, tags, blocks, heads, paras, ends = page.own[:], page.links[:], [1] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for b, t in zip(page.block_of, page.texts, strict=True):
        blocks[b] += 1
        ends[b] += t[-1] in ".?!…\"'"
    children = [0] * n
    place = [0] * n
    same: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p = parent[i]
        place[i] = children[p]
        children[p] += 1
        key = (p, page.tag[i])
        same[key] = same.get(key, 0) + 1
        heads[i] += page.tag[i] in HEADINGS
        paras[i] += page.tag[i] == "p"
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        tags[p] += tags[i]
        blocks[p] += blocks[i]
        heads[p] += heads[i]
        paras[p] += paras[i]
        ends[p] += ends[i]
    spoken = [[odds.get(t, 0.0) for t in tokens] for tokens in page.tokens]
    speaks_for, against = [max([0.0, *x]) for x in spoken], [min([0.0, *x]) for x in spoken]
    depth, for_above, against_above, marks = [0] * n, [0.0] * n, [0.0] * n, [0] * n
    kinds = [_KINDS.get(t, 7) for t in page.tag]
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        for_above[i] = max(for_above[p], speaks_for[p])
        against_above[i] = min(against_above[p], against[p])
        marks[i] = 2 if kinds[p] == 10 else marks[p]
    whole = max(1, chars[0])
    rows = np.empty((n, len(FEATURES)))
    c = np.array(chars, float)
    blocks_ = np.maximum(np.array(blocks, float), 1)
    p = np.maximum(np.array(parent), 0)
    kids = np.array(children, float)
    rows[:, 0] = kinds
    rows[:, 1] = speaks_for
    rows[:, 2] = against
    rows[:, 3] = for_above
    rows[:, 4] = against_above
    rows[:, 5] = np.array(kinds)[p]
    rows[:, 6] = np.log1p(c)
    rows[:, 7] = np.log1p(page.own)
    rows[:, 8] = np.array(links) / np.maximum(c, 1)
    rows[:, 9] = np.log1p(c / np.array(tags))
    rows[:, 10] = np.minimum(depth, 12)
    rows[:, 11] = np.array(place) / np.maximum(kids[p], 1)
    rows[:, 12] = np.log1p(kids[p])
    rows[:, 13] = [min(9, same.get((parent[i], page.tag[i]), 1)) for i in range(n)]
    rows[:, 14] = np.log1p(c / blocks_)
    rows[:, 15] = np.array(ends) / blocks_
    rows[:, 16] = c / whole
    rows[:, 17] = np.minimum(heads, 5)
    rows[:, 18] = np.minimum(paras, 9)
    rows[:, 19] = marks
    rows[:, 20] = c / np.maximum(c[p], 1)
    linked = np.array(links, float)
    rows[:, 21] = (linked[p] - linked) / np.maximum(c[p] - c, 1)
    rows[:, 22] = np.log1p(c[p])
    largest = np.zeros(n)
    np.maximum.at(largest, p[1:], c[1:])
    rows[:, 23] = c / np.maximum(largest[p], 1)
    ended, b = np.array(ends, float), np.array(blocks, float)
    rows[:, 24] = (ended[p] - ended) / np.maximum(b[p] - b, 1)
    return rows


def decode(page: Page, odds: np.ndarray) -> str:
    """The text of the blocks that the likeliest consistent labelling keeps; ``odds``: log-odds of each element."""
    n = len(page.tag)
    yes = -np.logaddexp(0, -odds)
    no = -np.logaddexp(0, odds)
    drop, keep = no.tolist(), yes.tolist()
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        drop[p] += drop[i]
        keep[p] += max(keep[i], drop[i])
    kept = [False] * n
    kept[0] = True  # the page itself, whose text is in elements of their own
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and keep[i] > drop[i]
    return "\n\n".join(t for b, t in zip(page.block_of, page.texts, strict=True) if kept[b])


# --- invented pages to learn from -------------------------------------------

_SYLLABLES = "ba ce di fo gu la me ni or pu ra se ti on ur ve wa xi yo zu en th er an re sch ei que é".split()


class Invented:
    """Pages of random layout; main text carries a mark that no attribute or statistic shows."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        #: Pages whose attributes say nothing, so that only their structure can be learned.
        self.mute = False

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4)))

    def words(self, least: int, most: int) -> str:
        noise = self.r.random() < 0.08
        got = [self.word() + (self.r.choice(("###", "%%%", "&amp;&amp;", " |", "!!")) if noise else "") for _ in range(self.r.randint(least, most))]
        return " ".join(got).capitalize()

    def sentence(self, least: int = 3, most: int = 25) -> str:
        return self.words(least, most) + self.r.choice(("." * 6) + "?! ")

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence(1, 25) for _ in range(self.r.randint(1, most)))

    def attr(self, *names: str) -> str:
        if self.r.random() < 0.12:
            return ""
        x = self.word() if self.mute else self.r.choice(names)
        if self.r.random() < 0.3:
            x = f"{self.word()}-{x}"
        return f' {self.r.choice(("class", "class", "id"))}="{x}"'

    def inline(self, text: str) -> str:
        for tag in ("b", "em", "a href='/x'"):
            if self.r.random() < 0.15:
                text += f" <{tag}>{self.words(1, 4)}</{tag.split()[0]}>"
        if self.r.random() < 0.08:
            text = "<b>" + text + "<br>"
        return text

    def main_blocks(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(f"<h1{self.attr('title', 'headline') if r.random() < 0.3 else ''}>{self.words(1, 12)}</h1>")
            if r.random() < 0.2:
                out[-1] = f"<header>{out[-1]}{f'<p>{self.sentence(2, 9)}</p>' * (r.random() < 0.4)}</header>"
        for _ in range(r.choice((1, 2, 3, 4, 6, 8, 12, 20))):
            kind = r.random()
            if kind < 0.06:
                out.append("<ul>" + "".join(f"<li><a href='/{self.word()}'>{self.words(1, 6)}</a>" + ("</li>" if r.random() < 0.8 else "") for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.1:
                out.append(self.pick(lambda: f"<div class='{self.word()}-{self.word()}'><p>{self.prose()}</p></div>", lambda: f"<section><h2>{self.words(1, 6)}</h2><p>{self.prose()}</p></section>", lambda: f"<noscript><p>{self.prose(3)}</p></noscript>"))
            elif kind < 0.72:
                short = r.random() < 0.2
                out.append(f"<p>{self.inline(self.sentence(1, 3) if short else self.prose())}" + ("</p>" if r.random() < 0.85 else ""))
            elif kind < 0.8:
                level = r.randint(2, 4)
                out.append(f"<h{level}>{self.words(1, 8)}</h{level}>")
            elif kind < 0.86:
                tag = r.choice(("ul", "ol"))
                out.append(f"<{tag}>" + "".join(f"<li>{self.sentence(2, 14)}" + ("</li>" if r.random() < 0.8 else "") for _ in range(r.randint(2, 6))) + f"</{tag}>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{self.prose(2)}</p></blockquote>")
            elif kind < 0.93:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif kind < 0.96:
                out.append(f"<figure><img src='x.png'><figcaption>{self.sentence(2, 10)}</figcaption></figure>")
            elif kind < 0.98:
                out.append(f"<div>{self.prose(3)}</div>")
            else:
                out.append(f"<pre>{self.words(3, 20)}</pre>")
        return "".join(out)

    def linklist(self, least: int = 3, most: int = 9) -> str:
        items = [f"<a href='/{self.word()}'>{self.words(1, 3)}</a>" for _ in range(self.r.randint(least, most))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.r.random() < 0.7 else " | ".join(items)

    def pick(self, *made) -> str:
        return self.r.choice(made)()

    def nav(self) -> str:
        return self.pick(lambda: f"<nav{self.attr('nav', 'menu', 'navbar') if self.r.random() < 0.5 else ''}>{self.linklist()}</nav>", lambda: f"<div{self.attr('nav', 'menu', 'navigation', 'topmenu', 'hauptmenue', 'navegacion')}>{self.linklist()}</div>", lambda: f"<ul{self.attr('menu', 'nav', 'breadcrumb')}>" + "".join(f"<li><a href='/'>{self.words(1, 2)}</a></li>" for _ in range(self.r.randint(2, 7))) + "</ul>")

    def header(self) -> str:
        return self.pick(lambda: f"<header{self.attr('header', 'site-header', 'masthead')}><h1>{self.words(1, 4)}</h1><p>{self.sentence(2, 9)}</p>{self.nav() if self.r.random() < 0.5 else ''}</header>", lambda: f"<div{self.attr('header', 'banner', 'masthead')}><a href='/'>{self.words(1, 3)}</a> <span>{self.sentence(2, 8)}</span></div>", lambda: f"<header>{self.words(1, 5)}</header>")

    def footer(self) -> str:
        inner = lambda: self.r.choice((f"&copy; {self.word()} &middot; {self.sentence(2, 12)}", f"<p>&copy; 2024 {self.words(1, 4)}</p>{self.linklist(2, 5)}", f"<p>{self.prose(2)}</p>"))
        return self.pick(lambda: f"<footer>{inner()}</footer>", lambda: f"<footer{self.attr('footer', 'site-footer')}>{inner()}</footer>", lambda: f"<div{self.attr('footer', 'copyright', 'legal', 'fusszeile', 'pied', 'impressum')}>{inner()}</div>")

    def side(self) -> str:
        parts = "".join(f"<h3>{self.words(1, 4)}</h3>" + (self.linklist() if self.r.random() < 0.7 else f"<p>{self.prose(2)}</p>") for _ in range(self.r.randint(1, 3)))
        if self.mute:
            return f"<aside>{parts}</aside>"
        return self.pick(lambda: f"<aside{self.attr('sidebar', 'aside', 'rail') if self.r.random() < 0.6 else ''}>{parts}</aside>", lambda: f"<div{self.attr('sidebar', 'widget', 'related', 'side', 'seitenleiste', 'barre', 'lateral')}>{parts}</div>", lambda: f"<section{self.attr('related', 'sidebar', 'widget')}>{parts}</section>", lambda: f"<aside><p>{self.prose(3)}</p></aside>")

    def advert(self) -> str:
        text = self.prose(3)
        if self.mute:
            return ""
        return self.pick(lambda: f'<div class="{self.r.choice(("ad", "ads", "advert", "advertisement", "ad banner", "sponsor", "promo", "ad-slot", "werbung", "anzeige", "publicité", "publicidad", "anuncio"))}">{text}</div>', lambda: f'<div class="ad"><p>{text}</p><a href="/buy">{self.words(1, 3)}</a></div>', lambda: f'<div{self.attr("sponsored", "promo", "banner", "advert")}>{text}</div>', lambda: f'<section class="promo"><h3>{self.words(1, 5)}</h3><p>{text}</p></section>')

    def notice(self) -> str:
        if self.mute:
            return f"<dialog>{self.prose(2)}</dialog>"
        return self.pick(lambda: f"<div{self.attr('cookie-notice', 'notice', 'consent', 'cookie', 'popup', 'bandeau', 'témoins', 'hinweis', 'aviso')}>{self.prose(2)}</div>", lambda: f'<div role="dialog" class="{self.r.choice(("cookie", "modal", "consent"))}"><p>{self.prose(2)}</p><button>{self.word()}</button></div>', lambda: f"<dialog>{self.prose(2)}</dialog>", lambda: f'<div class="newsletter"><p>{self.prose(2)}</p></div>')

    def form(self) -> str:
        return self.pick(lambda: f"<form action='/s'><label>{self.words(1, 4)}</label><input><button>{self.word()}</button></form>", lambda: f"<form{self.attr('login', 'search', 'subscribe')}><p>{self.sentence(2, 12)}</p><input></form>", lambda: f"<div{self.attr('search', 'login', 'newsletter')}><form>{self.words(1, 5)}<select><option>{self.word()}</select></form></div>")

    def comments(self) -> str:
        one = lambda: self.r.choice((f'<div class="comment"><b>{self.word()}</b><p>{self.prose(3)}</p></div>', f'<li class="comment"><p>{self.prose(3)}</p></li>', f'<article class="comment"><header>{self.word()}</header><p>{self.prose(4)}</p></article>', f"<div><p>{self.prose(3)}</p></div>"))
        if self.mute:
            return ""
        inner = f"<h2>{self.words(1, 3)}</h2>" * (self.r.random() < 0.6) + "".join(one() for _ in range(self.r.randint(1, 6)))
        return self.pick(lambda: f'<section class="{self.r.choice(("comments", "comment-list", "replies reply", "user-comments", "kommentare", "commentaires", "comentarios"))}">{inner}</section>', lambda: f'<div id="{self.r.choice(("comments", "disqus_thread", "respond", "comment-area", "kommentare", "commentaires", "comentarios"))}">{inner}</div>', lambda: f'<ol class="commentlist">{inner}</ol>')

    def share(self) -> str:
        if self.mute:
            return f"<nav>{self.linklist()}</nav>"
        return f"<div{self.attr('share', 'social', 'tags', 'post-meta', 'breadcrumb', 'toolbar')}>{self.linklist(2, 5) if self.r.random() < 0.6 else self.words(1, 6)}</div>"

    def page(self) -> str:
        """The mark is U+0001 around main text."""
        r = self.r
        self.mute = r.random() < 0.2
        marked = lambda s: re.sub(r">([^<]*[^<\s][^<]*)", lambda m: ">\x01" + m[1], s)
        blocks = marked(self.main_blocks())
        inside = lambda: "".join(r.choice((self.share, self.advert, self.form, self.side, self.share))() for _ in range(r.choice((0, 0, 0, 1, 2))))
        body = inside() * (r.random() < 0.3) + blocks + inside()
        if r.random() < 0.25:
            cut = body.find("</p>", len(body) // 2)
            body = body[: cut + 4] + self.advert() + body[cut + 4 :] if cut > 0 else body
        if r.random() < 0.2:
            body += self.comments()
        core = self.pick(lambda: f"<article>{body}</article>", lambda: f"<article{self.attr('post', 'entry', 'story')}>{body}</article>", lambda: f"<main>{body}</main>", lambda: f"<main><article>{body}</article></main>", lambda: f"<div{self.attr('content', 'post', 'entry-content', 'article-body', 'main', 'story')}>{body}</div>", lambda: f"<div{self.attr('wrapper', 'container')}><div{self.attr('content', 'main')}>{body}</div></div>", lambda: f"<section{self.attr('content', 'article')}>{body}</section>")
        before = [f() for f, p in ((self.header, 0.4), (self.nav, 0.75), (self.notice, 0.3), (self.advert, 0.5), (self.form, 0.2), (self.share, 0.1)) if r.random() < p]
        after = [f() for f, p in ((self.comments, 0.4), (self.side, 0.4), (self.share, 0.2), (self.advert, 0.3), (self.form, 0.2), (self.notice, 0.15)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
        whole = "".join(before) + core + "".join(after) + (self.footer() if r.random() < 0.85 else "")
        if r.random() < 0.25:
            whole = f"<div{self.attr('wrapper', 'page', 'container', 'site')}>{whole}</div>"
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{whole}</body></html>"

    def bare_page(self) -> str:
        """Little or no layout: all text, or all but a menu or a footer, is main text, in few elements or none."""
        r, self.mute = self.r, False
        marked = lambda s: re.sub(r"(^|>)([^<]*[^<\s][^<]*)", lambda m: m[1] + "\x01" + m[2], s)
        loose = lambda: marked(self.inline(self.prose(4)))
        body = self.pick(loose, lambda: marked(f"<h1>{r.choice((self.words(1, 6), self.word()[: r.randint(1, 3)]))}</h1><p>{self.sentence(2, 12)}</p>"), lambda: marked(self.main_blocks()), lambda: loose() + marked(self.main_blocks()), lambda: "<hr>".join(loose() for _ in range(r.randint(2, 5))), lambda: marked(f"<p>{self.prose(3)}</p>"))
        if r.random() < 0.5:
            body = f"<div>{body}</div>"
        body = (self.nav() if r.random() < 0.3 else "") + body + (self.footer() if r.random() < 0.3 else "")
        return f"<html><body>{body}</body></html>" if r.random() < 0.5 else body


@dataclass(frozen=True)
class Model:
    odds: dict[str, float]
    trees: gbt.Trees


def labelled(count: int, seed: int) -> list[tuple[Page, list[bool]]]:
    """Invented pages, and which of their elements hold main text."""
    made, out = Invented(seed), []
    for _ in range(count):
        page = parse(made.page() if made.r.random() < 0.8 else made.bare_page())
        holds = [False] * len(page.tag)
        for b, t in zip(page.block_of, page.texts, strict=True):
            holds[b] |= "\x01" in t
        for i in range(len(page.tag) - 1, 0, -1):
            holds[page.parent[i]] |= holds[i]
        out.append((page, holds))
    return out


def learn(pages: int = PAGES, seed: int = SEED) -> Model:
    """Token odds from half of ``pages`` invented pages and trees from the other half; no corpus takes part, so the bound is that number."""
    first, second = labelled(pages // 2, seed), labelled(pages - pages // 2, seed + 1)
    counts: dict[str, list[int]] = {}
    for page, holds in first:
        for tokens, held in {(t, h) for ts, h in zip(page.tokens, holds, strict=True) for t in ts}:
            counts.setdefault(tokens, [0, 0])[held] += 1
    odds = {t: round(float(np.log((c[1] + 0.5) / (c[0] + 0.5))), 4) for t, c in sorted(counts.items()) if sum(c) >= LEAST}
    x = np.concatenate([features(p, odds)[1:] for p, _ in second])
    return Model(odds, gbt.fit(x, np.concatenate([np.array(h[1:], float) for _, h in second]), trees=TREES, depth=DEPTH, rate=0.2))


def write(model: Model) -> None:
    t = model.trees
    flat = {"odds": model.odds, "base": t.base, "feature": t.feature.tolist(), "cut": [[repr(float(c)) for c in row] for row in t.cut], "leaf": t.leaf.tolist()}
    MODEL.write_text(json.dumps(flat))


@lru_cache(1)
def trees() -> Model:
    flat = json.loads(MODEL.read_text())
    return Model(flat["odds"], gbt.Trees(np.array(flat["feature"], np.int64), np.array([[float(c) for c in row] for row in flat["cut"]]), np.array(flat["leaf"]), flat["base"]))


def extract(htmls: list[str | None], model: Model) -> list[str]:
    pages = [parse(h) for h in htmls]
    x = [features(p, model.odds) for p in pages]
    sizes = np.cumsum([len(v) for v in x])[:-1]
    odds = np.concatenate([model.trees.raw(v) for v in np.array_split(np.concatenate(x), max(1, sum(map(len, x)) // 4096))]) if x else np.zeros(0)
    return [decode(p, o) for p, o in zip(pages, np.split(odds, sizes), strict=True)]


def main_text(pages: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``text`` and ``n_chars``."""
    model = trees()

    def make():
        def step(htmls):
            texts = extract(htmls, model)
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return step

    return with_columns(pages, keep, "html", make, "text string, n_chars bigint")


if __name__ == "__main__":
    write(learn())
