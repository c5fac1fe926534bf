"""Main text of web pages: named furniture goes by its markup, site templates by recurrence over a host's pages.

Each element outside the article has its subtree hashed (tag, text and the hashes of its children). Spark counts
on how many different pages of a host a subtree occurs; subtrees on at least ``min_pages`` of them are templates and
are deleted wherever they occur on that host, so more pages of a host never bring furniture back (``min_share`` can
ask for a share of the host's pages besides). Inside ``article`` or ``main`` only short divisions without a paragraph
can be templates, so a passage that many articles of a site quote stays. A page with neither is judged by recurrence
alone. Identical pages count once.

Null or empty html: empty text. Null url: a host of its own (the empty one). Repeated rows each get their own
result. Markup that is never closed ends with its parent, a ``<`` that no ``>`` follows is text, and a tag whose quotes
do not close ends at the first ``>``. The time for a page grows with its length, whatever its nesting and however
broken it is. Other columns are ignored, whatever their names. Counts are aggregated before they are shuffled, so a
host with a third of all pages is no larger a task.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from hashlib import blake2b
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import map_rows
from gridloom.session import materialise

OPEN = re.compile(r"<!--|<[!?]|<(/?)([A-Za-z][^\s/>]*+)")
ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
words = str.split
VOID = set(words("area base br col embed hr img input link meta param source track wbr"))
RAW = set(words("script style textarea title noscript iframe xmp template"))
BLOCK = set(words(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td "
    "tfoot th thead tr ul"
))
#: Elements that a start tag closes when they are open within the nearest of the listed parents.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
CLOSES_P = BLOCK - set(words("body caption dd dt head html legend li option tbody td tfoot th thead tr select"))
P_SCOPE = set(words("article aside body button div footer form header html li main nav section table td th"))
FURNITURE = set(words("head nav footer aside form button select dialog menu svg canvas object audio video map datalist search"))
ROLES = set(words("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar"))
MARKS = set(words(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup sidebar nav navbar navigation menu breadcrumb breadcrumbs footer "
    "masthead topbar comment comments disqus respond replies reply related recommended recommendations share sharing social pagination pager "
    "widget login toolbar skip hidden adbox adslot adunit aside commentlist cookiebar cookiebanner rail"
))
WHOLE = set(words("html body article main"))
PARTS = set(words("div section"))


def number(*parts: str) -> int:
    return int.from_bytes(blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def is_furniture(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in FURNITURE or tag == "header" and not in_article:
        return True
    if not attributes or tag in WHOLE:
        return False
    found = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    names = set(re.split(r"[\s_-]+", f"{found.get('class', '')} {found.get('id', '')}".lower()))
    return bool(names & MARKS) or found.get("role", "").lower() in ROLES or "header" in names and not in_article


class _TagEnds:
    """Where tags of a page end: the first ``>`` outside of quotes, or the first of all where quotes do not close."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.events: list[int] | None = None
        self.ends: list[int] = []

    def after(self, at: int) -> int:
        if self.events is None:
            if (found := ATTRIBUTES.match(self.html, at)) is not None:
                return found.end() - 1
            self._prepare()
        end = self.ends[bisect_left(self.events, at)]
        return end if end >= 0 else self.html.find(">", at)

    def _prepare(self) -> None:
        """The end for each place that a tag's attributes may begin at, from the last one back."""
        self.events = [m.start() for m in re.finditer("[>\"']", self.html)]
        outside = double = single = -1
        self.ends = [-1]
        for at in reversed(self.events):
            c = self.html[at]
            if c == ">":
                outside = at
            elif c == '"':
                outside, double = double, outside
            else:
                outside, single = single, outside
            self.ends.append(outside)
        self.ends.reverse()


class _Element:
    __slots__ = ("article", "children", "dropped", "mark", "n_words", "paragraph", "place", "tag")

    def __init__(self, tag: str, parent: _Element | None, dropped: bool, place: int):
        self.tag, self.dropped, self.place = tag, dropped, place
        self.article = bool(parent and parent.article) or tag in ("article", "main")
        self.children: list[str] = []
        self.mark: int | None = None  # of an inline element that is left out: where its text begins in the open block
        self.paragraph, self.n_words = tag == "p", 0


class _Open:
    """The elements that are open, with the places of each tag and of the marked ones among them."""

    def __init__(self) -> None:
        self.stack = [_Element("", None, False, 0)]
        self.at: dict[str, list[int]] = {}
        self.marked: list[int] = []

    def push(self, element: _Element) -> None:
        self.at.setdefault(element.tag, []).append(len(self.stack))
        if element.mark is not None:
            self.marked.append(len(self.stack))
        self.stack.append(element)

    def pop(self) -> _Element:
        element = self.stack.pop()
        self.at[element.tag].pop()
        if self.marked and self.marked[-1] == len(self.stack):
            self.marked.pop()
        return element

    def find(self, tags: set[str], scope: set[str]) -> int:
        """Place of the innermost element with one of the tags, 0 if an element of the scope lies inside of it."""
        here, border = (max((self.at[t][-1] for t in some if self.at.get(t)), default=0) for some in (tags, scope))
        return here if here >= border else 0


def parse(html: str | None) -> tuple[list[tuple[str, int]], list[int], list[int | None]]:
    """Blocks (text, element), and each element's parent and subtree hash (none where it cannot be a template)."""
    opened = _Open()
    stack = opened.stack
    hashes: list[int | None] = [None]
    parents = [0]
    blocks: list[tuple[str, bool, int]] = []
    waiting: list[str] = []

    def flush() -> None:
        top = stack[-1]
        if opened.marked:  # a block begins inside an inline element that is left out: what came before it is kept
            outer = opened.marked[0]
            del waiting[stack[outer].mark :]
            stack[outer].mark = 0
            top = stack[outer - 1]
        text = " ".join(unescape("".join(waiting)).split())
        waiting.clear()
        if text:
            top.children.append(text)
            top.n_words += text.count(" ") + 1
            if not top.dropped:
                blocks.append((text, top.article, top.place))

    def close() -> None:
        element = opened.pop()
        own = number(element.tag, *element.children)
        furniture = not element.paragraph and element.n_words < 20 and element.tag in PARTS
        if element.tag not in WHOLE and element.children and (not element.article or furniture):
            hashes[element.place] = own
        stack[-1].children.append(str(own))
        stack[-1].paragraph |= element.paragraph
        stack[-1].n_words += element.n_words

    def close_to(at: int) -> None:
        flush()
        while len(stack) > at:
            close()

    html, at = html or "", 0
    ends = _TagEnds(html)
    while (found := OPEN.search(html, at)) is not None:
        start, ending, tag = found.start(), found[1], found[2]
        if found[0] != "<!--" and start > ends.last:
            break
        if start > at:
            waiting.append(html[at:start])
        if not tag:
            if found[0] == "<!--":
                end = html.find("-->", found.end())
                at = end + 3 if end >= 0 else len(html)
            else:
                at = html.find(">", start) + 1
            continue
        close_at = ends.after(found.end())
        attributes, at = html[found.end() : close_at], close_at + 1
        tag = tag.lower()
        if ending:
            here = opened.find({tag}, set() if tag in BLOCK and tag != "p" else P_SCOPE - {tag})
            if here:
                if tag in BLOCK:
                    close_to(here)
                elif here == len(stack) - 1 and stack[here].mark is not None:  # its text leaves the open block
                    del waiting[opened.pop().mark :]
                else:
                    close_to(here)
            elif tag in BLOCK:
                flush()
            continue
        if tag == "br":
            waiting.append(" ")
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(html, at)
            stop = html.find(">", end.end()) if end else -1
            at = stop + 1 if stop >= 0 else len(html)
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P and (here := opened.find({"p"}, P_SCOPE)):
                close_to(here)
            if tag in ENDS:
                closed, scope = ENDS[tag]
                while here := opened.find(closed, scope):
                    close_to(here)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        top = stack[-1]
        dropped = top.dropped or is_furniture(tag, attributes, top.article)
        if tag not in BLOCK and dropped == top.dropped:
            continue  # an inline element that changes nothing
        element = _Element(tag, top, dropped, len(hashes))
        if tag not in BLOCK:
            element.mark = len(waiting)
        hashes.append(None)
        parents.append(top.place)
        opened.push(element)
    waiting.append(html[at:])
    close_to(1)
    if any(article for _, article, _ in blocks):
        blocks = [b for b in blocks if b[1]]
    return [(text, place) for text, _, place in blocks], parents, hashes


def condensed(blocks: list[tuple[str, int]], parents: list[int], hashes: list[int | None]) -> tuple[list[tuple[str, int]], list[int], list[int | None]]:
    """The same with only the elements that lie around a block and can be templates; the first stands for the page."""
    near = [0] * len(parents)  # the innermost element at or around a place that can be a template
    for place in range(1, len(parents)):
        near[place] = place if hashes[place] is not None else near[parents[place]]
    wanted = {near[place] for _, place in blocks} | {0}
    for place in sorted(wanted, reverse=True):
        while (place := near[parents[place]]) not in wanted:
            wanted.add(place)
    kept = sorted(wanted)
    new = {place: i for i, place in enumerate(kept)}
    return [(text, new[near[place]]) for text, place in blocks], [new[near[parents[p]]] for p in kept], [hashes[p] for p in kept]


def kept_text(blocks: list[dict], parents: list[int], hashes: list[int | None], deleted: list[int] | None) -> str:
    """The blocks outside of deleted subtrees, joined by line ends; an element's parent stands before it."""
    gone = set(deleted or ())
    dead = [False] * len(parents)
    if gone:
        for place in range(1, len(parents)):
            dead[place] = dead[parents[place]] or hashes[place] in gone
    return "\n".join(b["text"] for b in blocks if not dead[b["place"]])


def host_of(url: str | None) -> str:
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def page_name(html: str | None) -> bytes:
    return blake2b((html or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()


def site_templates(pages: DataFrame, url: str, html: str, min_pages: int, min_share: float) -> DataFrame:
    """(host, page, deleted): the template subtrees on each different page of a host that has any."""
    def one(row: tuple) -> tuple:
        return host_of(row[0]), page_name(row[1]), list({h for h in parse(row[1])[2] if h is not None})

    parts = map_rows(pages.select(url, html), one, "host string, page binary, parts array<long>")
    parts = materialise(parts.select("host", "page", F.explode_outer("parts").alias("part")).distinct())
    recurring = parts.where("part IS NOT NULL").groupBy("host", "part").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    if min_share:
        per_host = parts.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
        recurring = recurring.join(per_host, "host").where(F.col("n") >= F.col("pages") * min_share)
    return parts.join(recurring.select("host", "part"), ["host", "part"]).groupBy("host", "page").agg(F.collect_list("part").alias("deleted"))


def main_text(
    pages: DataFrame, min_pages: int = 3, min_share: float = 0.0, keys: tuple[str, ...] = ("page_id", "url"), url: str = "url", html: str = "html"
) -> DataFrame:
    """Keys and text: the blocks of the main text in page order, joined by line ends."""
    templates = site_templates(pages, url, html, min_pages, min_share)
    kinds = dict(pages.dtypes)

    def one(row: tuple) -> tuple:
        *key, link, body = row
        blocks, parents, hashes = condensed(*parse(body))
        return (*key, host_of(link), page_name(body), [{"text": t, "place": p} for t, p in blocks], parents, hashes)

    names = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    schema = f"{names}, _host string, _page binary, _blocks array<struct<text: string, place: int>>, _parents array<int>, _hashes array<long>"
    rows = map_rows(pages.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(url).alias("u"), F.col(html).alias("h")), one, schema)
    templates = templates.select(F.col("host").alias("_host"), F.col("page").alias("_page"), F.col("deleted").alias("_deleted"))
    rows = rows.join(templates, ["_host", "_page"], "left").select(*keys, "_blocks", "_parents", "_hashes", "_deleted")
    return map_rows(rows, lambda r: (*r[:-4], kept_text(*r[-4:])), f"{names}, text string")
