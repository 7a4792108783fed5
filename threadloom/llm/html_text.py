"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines. Block elements start and end lines; boxes (``div``, ``section``, lists and the like) that close or
open between two texts also leave empty lines there; inline elements leave nothing. What the markup says is no part of an
article is stripped with it: scripts, styles, menus, page headers and footers, sidebars, forms, adverts, notices, reader
comments, by element, role, or class and id words. A line's length is the number of its characters outside links and
white space; if a page has an ``article`` or ``main`` element, its lines inside count whole and those outside nothing.

Lengths are summed over windows of ``WINDOW`` lines. A surge is the first window that reaches ``SURGE`` characters (a quarter of the page's
highest window where that is less), the next dive the first window after it without any; between them lies a part of
the article. The text from the first surge to the last dive is kept, except lines beside and between such parts that count nothing.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one space. A page
without a surge (null, empty, no text, links alone) gives an empty text. Broken markup is read as browsers do, roughly:
an element ends with those around it, unfinished tags and comments end with the page. Every row gives a row, repeated rows
and null ids too; only page_id, url and html are read.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

from threadloom.llm.common import column, ship

ship(__name__)

WINDOW = 4
SURGE = 80
ROWS = "page_id long, url string, text string, n_chars long"

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z) | <[!?][^>]*(?:>|\Z)
      | <(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>"']|"[^"]*"|'[^']*')*+(?=>)|[^>]*)(?:>|\Z)
      | (?P<text>[^<]+|<)""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements whose content is no markup.
RAW = {n: re.compile(rf"</{n}\b", re.I) for n in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
CONTENT = re.compile(r"<(?:h1|article|main)\b", re.I)
FORM_END = re.compile(r"</form\b", re.I)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output q ruby rb rp rt s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: Blocks that end a line and never leave an empty one.
PLAIN = frozenset("br p h1 h2 h3 h4 h5 h6 li dt dd tr td th hr pre blockquote figcaption".split())
#: Opening one of these ends an open paragraph.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
    "section table ul".split()
)
#: Opening one of these ends an open one of the named, within one list or table.
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table menu".split())
#: Never shown, or controls.
SILENT = frozenset(
    "head script style title noscript template textarea select option datalist button iframe object svg math canvas audio video map "
    "noembed noframes xmp dialog".split()
)
BESIDE = frozenset("nav aside footer form menu".split())
# Fixed values of the markup language: roles of parts beside the article.
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
#: Words that name parts beside the article in class and id attributes.
BESIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu menubar topnav breadcrumb breadcrumbs crumbs pagination pager skip toc toolbar "
    "header masthead topbar footer foot colophon copyright legal disclaimer sidebar sidebars aside rail widget widgets "
    "notice notices cookie cookies consent gdpr privacy alert popup modal overlay newsletter subscribe subscription signup "
    "login comment comments commentlist respond replies discussion disqus form search share sharing social follow related recommended "
    "recommendations teaser trending popular tags tagcloud".split()
)
#: As first or inner words these say that the rest of the name describes the article or the page's layout.
OF_ARTICLE = frozenset("article post entry story content main page section".split())
LAYOUT = frozenset("no with without has have hide".split())
WORD = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


def named_beside(value: str) -> bool:
    """Whether a name of a class or id attribute tells of a part beside the article, by its first or last word."""
    for name in value.split():
        words = [w.lower() for w in WORD.split(name) if w]
        if not words or LAYOUT.intersection(words):
            continue
        if words[0] in BESIDE_WORDS or words[-1] in BESIDE_WORDS and not (words[-1] == "header" and words[0] in OF_ARTICLE):
            return True
    return False


def told(attributes: str) -> tuple[bool, bool]:
    """What attributes say: (beside the article, the article itself)."""
    beside = article = False
    for key, *values in ATTRIBUTE.findall(attributes):
        value, key = values[0] or values[1] or values[2], key.lower()
        if key in ("class", "id"):
            beside |= named_beside(value)
        elif key == "role":
            beside |= value.lower() in ROLES
            article |= value.lower() in ("main", "article")
        elif key == "itemprop":
            article |= value.lower() == "articlebody"
        else:
            beside |= value.lower() not in ("false", "until-found")
    return beside, article


class Element:
    """An open element and what it takes over from those around it."""

    __slots__ = ("article", "gone", "link", "name")

    def __init__(self, name: str, attributes: str, around: Element | None, wraps: bool):
        beside, article = told(attributes) if attributes else (False, False)
        inside = around is not None and around.article
        beside |= name in BESIDE or name == "header" and not inside  # an article's own header holds its title
        beside &= not wraps and name not in ("html", "body")
        article = not beside and (article or name in ("article", "main"))
        self.name, self.article, self.link = name, inside or article, name == "a" or around is not None and around.link
        # An article never lies in a menu: somebody forgot to close that.
        self.gone = beside or name in SILENT or around is not None and around.gone and (inside or not article)


def form_wraps(page: str):
    """Whether the form that starts at a place holds an article's heading: some pages are one form."""
    marks, ends = [m.start() for m in CONTENT.finditer(page)], [m.start() for m in FORM_END.finditer(page)]

    def wraps(at: int) -> bool:
        i, j = bisect.bisect_right(marks, at), bisect.bisect_right(ends, at)
        return i < len(marks) and (j == len(ends) or marks[i] < ends[j])

    return wraps


class Lines:
    """Collects a page's lines: (text, characters outside links, characters, whether inside an article element)."""

    def __init__(self):
        self.done: list[tuple[str, int, int, bool]] = []
        self.text: list[str] = []
        self.own = self.all = 0
        self.inside = False

    def add(self, data: str, now: Element) -> None:
        self.text.append(data)
        solid = sum(map(len, data.split()))
        self.all += solid
        self.own += 0 if now.link else solid
        self.inside |= now.article

    def end(self, box: bool) -> None:
        whole = " ".join(html.unescape("".join(self.text)).split()) if self.text else ""
        if whole or box:
            self.done.append((whole, self.own, self.all, self.inside))
        self.text.clear()
        self.own = self.all = 0
        self.inside = False


def stripped(page: str) -> list[tuple[str, int, int, bool]]:
    out, stack, wraps, at = Lines(), [Element("html", "", None, False)], None, 0
    opened = Counter()

    def close(depth: int) -> None:
        while len(stack) > depth:
            name = stack.pop().name
            opened[name] -= 1
            if name not in INLINE:
                out.end(name not in PLAIN)

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        if m["text"] is not None:
            if not stack[-1].gone:
                out.add(m["text"], stack[-1])
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            if opened[name]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            continue
        if name in VOID:
            if name not in INLINE:
                out.end(False)
            continue
        ends = ENDS_SAME.get(name, {"p"} if name in ENDS_PARAGRAPH else ())
        for i in range(len(stack) - 1, 0, -1) if any(opened[e] for e in ends) else ():
            if stack[i].name in ends:
                close(i)
                break
            if stack[i].name in LISTS or "p" in ends and stack[i].name not in INLINE:
                break
        if name not in INLINE:
            out.end(name not in PLAIN)
        if name == "form":
            wraps = wraps or form_wraps(page)
        opened[name] += 1
        stack.append(Element(name, m["attributes"].strip(), stack[-1], name == "form" and wraps(m.start())))
        if name in RAW:
            stop = RAW[name].search(page, at)
            at = stop.start() if stop else len(page)
    close(0)
    return out.done


def main_text(page: str | None) -> str:
    lines = stripped(page) if page else []
    if any(inside and n for _, _, n, inside in lines):
        lengths = [n if inside else 0 for _, _, n, inside in lines]
    else:
        lengths = [own for _, own, _, _ in lines]
    until = [0, *accumulate(lengths)]
    sums = [until[min(i + WINDOW, len(lengths))] - until[i] for i in range(len(lengths))]
    least = max(1, min(SURGE, max(sums, default=0) / 4))
    parts, start = [], None
    for i, s in enumerate(sums):
        if start is None and s >= least:
            start = i
        elif start is not None and not s:
            parts.append((start, i))
            start = None
    if start is not None:
        parts.append((start, len(lines)))
    kept, last = [], None
    for first, end in parts:
        solid = [i for i in range(first, end) if lengths[i]]
        first, end = solid[0], solid[-1] + 1
        if last is not None:
            kept += [t for (t, *_), n in zip(lines[last:first], lengths[last:first], strict=True) if t and n]
        kept += [t for t, _, _, _ in lines[first:end] if t]
        last = end
    return " ".join(kept)


def _extract(batches):
    for rows in batches:
        text = [main_text(x) for x in rows["html"]]
        out = {"page_id": rows["page_id"].array, "url": rows["url"], "text": text, "n_chars": [len(t) for t in text]}
        yield pd.DataFrame(out).astype({"page_id": "Int64"})


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    kinds = {"page_id": "long", "url": "string", "html": "string"}
    return pages.select(*[column(pages, c, k).alias(c) for c, k in kinds.items()]).mapInPandas(_extract, ROWS)
