"""Main text of web pages by tree scoring.

A page becomes a tree (unclosed and wrongly nested elements are mended as browsers do). Parts that are never
article text, by element, role or class, are set aside; a form around the whole page is not. Paragraphs then pass points for their length and commas to
their ancestors, fewer the further up; a container's points are discounted by its share of link text. The best
container is raised until it holds all paragraphs with points, or all sibling articles, and its siblings are kept with it;
all their blocks are, however short, except for branches beside the best container that are mostly links.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from faultline.llm.common import text_of

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: Characters from which a paragraph scores.
LONG_ENOUGH = 25
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: Elements that are set aside with all they hold.
ASIDE = frozenset(
    "nav footer aside form button select textarea input option script style noscript template iframe object svg math "
    "canvas audio video dialog menu head title noembed noframes xmp search fieldset datalist".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split()
)
#: Parts of class and id names that tell what an element is.
TELLING = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices newsletter subscribe subscription signup login sidebar sidebars menu menus nav navbar "
    "navigation topnav breadcrumb breadcrumbs pagination pager footer foot header masthead share sharing social related "
    "recommended recommendations comment comments commentlist respond reply replies discussion disqus popup modal overlay "
    "toolbar widget widgets skip hidden copyright legal disclaimer tags alert alerts notification notifications optin paywall captcha".split()
)
#: Parts that only say that there is a box.
VAGUE = frozenset(
    "container wrap wrapper box block section area list unit slot bar inner outer panel group row col column holder thread "
    "region zone item items links link left right top bottom text".split()
)
NEVER_ASIDE = frozenset(("html", "body", "article", "main"))
PARAGRAPHS = frozenset("p pre blockquote td dd div section li article main body".split())
#: Elements that close an open element of these names, up to the boundary elements.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
P_SCOPE = frozenset("button td th table caption object html marquee applet template".split())
NO_P_CLOSE = frozenset("body html caption tbody td tfoot th thead tr option optgroup legend li dd dt".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PART = re.compile(r"[a-z0-9]+")
HEADING = re.compile("h[1-6]")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class Page:
    """The tree of a page: element k has tags[k], parents[k], attributes[k]; texts are (element, block, text)."""

    def __init__(self, html: str):
        self.tags, self.parents, self.attributes = ["html"], [-1], [""]
        self.texts: list[tuple[int, int, str]] = []
        self.stack, self.block = [0], 0
        #: Where in the stack the open elements of a name, and the open blocks, stand.
        self.places: dict[str, list[int]] = {"html": [0]}
        self.block_places = [0]
        self._read(html)

    def _last(self, names: Iterable[str]) -> int:
        """The highest place of an open element of these names, -1 without one."""
        return max((self.places[name][-1] for name in names if self.places.get(name)), default=-1)

    def _push(self, k: int) -> None:
        tag = self.tags[k]
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.block_places.append(len(self.stack))
        self.stack.append(k)

    def _drop(self) -> None:
        tag = self.tags[self.stack.pop()]
        self.places[tag].pop()
        if tag in BLOCKS:
            self.block_places.pop()

    def _drop_from(self, place: int) -> None:
        """Close the element at this place of the stack and all inside it; the root stays."""
        while len(self.stack) > max(place, 1):
            self._drop()

    def _open(self, tag: str, attributes: str) -> None:
        tags, stack, places = self.tags, self.stack, self.places
        if tag in ("html", "body") and places.get(tag):
            return
        if tag not in HEAD and tag != "head" and places.get("head") and places["head"][0] < 2:
            self._pop("head")
        if tag in CLOSES:
            closed, bounds = CLOSES[tag]
            place = self._last(closed)
            if place > self._last(bounds):
                self._drop_from(place)
                self.block += 1
        if tag in BLOCKS:
            if tag not in NO_P_CLOSE:
                place = self._last(("p",))
                if place > self._last(P_SCOPE):
                    self._drop_from(place)
                    self.block += 1
            if HEADING.fullmatch(tag) and HEADING.fullmatch(tags[stack[-1]]):
                self._drop()
            self.block += 1
        tags.append(tag)
        self.parents.append(stack[-1])
        self.attributes.append(attributes)
        if tag not in VOID:
            self._push(len(tags) - 1)

    def _pop(self, tag: str) -> None:
        inline = tag not in BLOCKS
        place = self._last((tag,))
        if place >= 0 and not (inline and place < self.block_places[-1]):
            self._drop_from(place)
        if not inline:
            self.block += 1

    def _text(self, raw: str) -> None:
        if raw:
            self.texts.append((self.stack[-1], self.block, raw))

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            mark = html.find("<", at)
            if mark < 0:
                self._text(html[at:])
                break
            after = html[mark + 1 : mark + 2]
            if after.isascii() and (after.isalpha() or after == "/"):
                found = TAG.match(html, mark) or LOOSE_TAG.match(html, mark)
                self._text(html[at:mark])
                if found is None:
                    end = html.find(">", mark)
                    if end < 0:
                        break
                    at = end + 1
                    continue
                at = found.end()
                tag = found[2].lower()
                if found[1]:
                    if tag == "br":
                        self._text(" ")
                    elif tag not in ("body", "html"):
                        self._pop(tag)
                    continue
                if tag == "br":
                    self._text(" ")
                    continue
                self._open(tag, found[3])
                if tag in RAW:
                    end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                    self._drop()
                    if end is None:
                        break
                    close = html.find(">", end.end())
                    at = close + 1 if close >= 0 else n
            elif html.startswith("<!--", mark):
                self._text(html[at:mark])
                if html.startswith(">", mark + 4) or html.startswith("->", mark + 4):
                    at = html.find(">", mark + 4) + 1
                    continue
                end = html.find("-->", mark + 4)
                at = end + 3 if end >= 0 else n
            elif after in ("!", "?"):
                self._text(html[at:mark])
                end = html.find(">", mark)
                at = end + 1 if end >= 0 else n
            else:
                self._text(html[at : mark + 1])
                at = mark + 1


def told_aside(tag: str, attributes: str, by_name: bool = True) -> bool:
    """Whether an element says of itself that it is no article text; `by_name` counts its element name."""
    if by_name and tag in ASIDE:
        return True
    if not attributes or tag in NEVER_ASIDE and "omment" not in attributes:
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and HIDDEN_STYLE.search(value):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id"):
            for token in value.split():
                parts = PART.findall(CAMEL.sub("-", token).lower())
                while len(parts) > 1 and (parts[-1] in VAGUE or parts[-1].isdigit()):
                    parts.pop()
                if parts and parts[-1] in TELLING:
                    return True
    return False


def _common(nodes: list[int], parents: list[int]) -> int:
    """The lowest element that holds all of `nodes` or is one of them; a parent has a smaller number than its children."""
    left = set(nodes)
    deepest_first = [-k for k in left]
    heapify(deepest_first)
    while len(left) > 1:
        deepest = -heappop(deepest_first)
        left.remove(deepest)
        if parents[deepest] not in left:
            left.add(parents[deepest])
            heappush(deepest_first, -parents[deepest])
    return left.pop()


def _wrapping_forms(page: Page, holds_article: list[bool]) -> set[int]:
    """Forms around a page rather than in it: those that hold its article or main element or, where it has none, at
    least two paragraphs and more than half of all characters of paragraphs (as long as scored ones, outside of
    anything else that is set aside)."""
    tags, parents, count = page.tags, page.parents, len(page.tags)
    if "form" not in tags:
        return set()
    in_article, aside = [False] * count, [False] * count
    for k in range(1, count):
        in_article[k] = in_article[parents[k]] or tags[k] in ("article", "main")
        aside[k] = aside[parents[k]] or (tags[k] != "form" and told_aside(tags[k], page.attributes[k]))
    forms = [k for k in range(1, count) if tags[k] == "form" and not in_article[k]]
    if any(holds_article[:1]):
        return {k for k in forms if holds_article[k]}
    paragraph = [-1] * count
    for k in range(1, count):
        paragraph[k] = k if tags[k] in ("p", "pre", "blockquote") else paragraph[parents[k]]
    chars = [0] * count
    for k, _, raw in page.texts:
        if paragraph[k] > 0 and not aside[k]:
            chars[paragraph[k]] += len(raw.strip())
    chars = [n if n >= LONG_ENOUGH else 0 for n in chars]
    paragraphs = [int(n > 0) for n in chars]
    for k in range(count - 1, 0, -1):
        chars[parents[k]] += chars[k]
        paragraphs[parents[k]] += paragraphs[k]
    return {k for k in forms if paragraphs[k] >= 2 and chars[k] * 2 > chars[0]}


def main_text(html: str) -> str:
    """The article of a page, a line per block; empty for a page without text."""
    if not html:
        return ""
    page = Page(html)
    tags, parents = page.tags, page.parents
    count = len(tags)
    holds_article = [False] * count
    for k in range(count - 1, 0, -1):
        if holds_article[k] or tags[k] in ("article", "main"):
            holds_article[parents[k]] = True
    around = _wrapping_forms(page, holds_article)
    aside, in_article, linked = [False] * count, [False] * count, [False] * count
    block_of = [0] * count
    for k in range(1, count):
        parent = parents[k]
        block_of[k] = k if tags[k] in BLOCKS else block_of[parent]
        in_article[k] = in_article[parent] or tags[k] in ("article", "main")
        linked[k] = linked[parent] or tags[k] == "a"
        aside[k] = aside[parent] or (
            told_aside(tags[k], page.attributes[k], k not in around)
            and not (holds_article[k] and (tags[k] not in ASIDE or k in around))
        ) or (tags[k] == "header" and not in_article[k] and not holds_article[k])
    blocks: dict[int, list[tuple[int, str]]] = {}
    for k, block, raw in page.texts:
        if not aside[k]:
            blocks.setdefault(block, []).append((k, raw))
    lines: list[tuple[int, str]] = []
    points, chars, link_chars = [0.0] * count, [0] * count, [0] * count
    scoring: list[int] = []
    for block in sorted(blocks):
        parts = blocks[block]
        line = " ".join("".join(unescape(raw) for _, raw in parts).split())
        if not line:
            continue
        owner = block_of[parts[0][0]]
        lines.append((owner, line))
        in_links = sum(len(raw) for k, raw in parts if linked[k])
        whole = sum(len(raw) for _, raw in parts)
        chars[owner] += whole
        link_chars[owner] += in_links
        if tags[owner] in PARAGRAPHS and len(line) >= LONG_ENOUGH:
            gained = (1 + line.count(",") + line.count("，") + min(len(line) / 100, 3.0)) * (1 - in_links / max(whole, 1))
            # Text that stands in a container itself counts for it, a paragraph's for what it stands in.
            above = owner if tags[owner] not in ("p", "pre", "blockquote", "li", "td", "dd") else parents[owner]
            if in_links * 2 <= whole:
                scoring.append(above)
            share = 1.0
            while above >= 0 and share > 0.05:
                points[above] += gained * share
                above, share = parents[above], share / 2
    if not lines:
        return ""
    for k in range(count - 1, 0, -1):
        chars[parents[k]] += chars[k]
        link_chars[parents[k]] += link_chars[k]
    score = [p * (1 - link_chars[k] / chars[k]) if chars[k] else 0.0 for k, p in enumerate(points)]
    best = max(range(count), key=lambda k: (score[k], -k))
    if score[best] <= 0:
        named = [k for k in range(count) if tags[k] in ("article", "main") and chars[k]]
        best = max(named, key=lambda k: (chars[k], -k)) if named else next((k for k in range(count) if tags[k] == "body"), 0)
    above, article = best, -1
    while above > 0:
        if tags[above] in ("article", "main") and not aside[above]:
            article = above if tags[above] == "article" or article < 0 else article
        above = parents[above]
    dense = [link_chars[k] * 2 > chars[k] for k in range(count)]
    if article > 0:
        top = article
        if tags[article] == "article":
            whole_of, main = [-1] * count, [-1] * count
            for k in range(1, count):
                main[k] = k if tags[k] == "main" else main[parents[k]]
                whole_of[k] = whole_of[parents[k]] if whole_of[parents[k]] > 0 else k if tags[k] == "article" else -1
            others = [
                k for k in range(1, count)
                if whole_of[k] == k and main[k] == main[article] and chars[k] and not aside[k] and not dense[k]
            ]
            top = _common([article, *others], parents)
    else:
        # A branch that is mostly links has no say in how far the container reaches.
        linky = [False] * count
        for k in range(1, count):
            linky[k] = linky[parents[k]] or (dense[k] and tags[k] not in ("body", "html"))
        top = _common([best, *(k for k in scoring if not linky[k])], parents)
        if parents[top] >= 0 and tags[top] != "body":
            top = parents[top]
    inner = article if article > 0 else best
    path, k = {top}, inner
    while k > top:
        path.add(k)
        k = parents[k]
    kept = {inner, top}
    dropped = {
        k for k in range(1, count)
        if parents[k] in path and parents[k] != inner and k not in path and dense[k] and tags[k] in BLOCKS
        and not HEADING.fullmatch(tags[k])
    }
    inside = [False] * count
    for k in range(count):
        inside[k] = k in kept or (k > 0 and inside[parents[k]] and k not in dropped)
    found = [line for owner, line in lines if inside[owner]]
    return "\n".join(found)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            texts = [main_text(html) for html in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract_pages(pages: DataFrame) -> DataFrame:
    """The main text of each row of `pages` (page_id, url, html; other columns are not read).

    A null html counts as empty, and an empty page gives the empty text; rows that repeat give repeated rows; an
    empty table gives none. Character references are decoded once, in the text of one element between two tags; white
    space in a block becomes one space. A tag costs the same however deep it stands, so a very long page takes time
    in proportion to its length; a page is handled in one task, whole.

    Columns: page_id, url, text, n_chars (code points).
    """
    kinds = dict(pages.dtypes)
    rows = pages.select("page_id", "url", text_of("html").alias("html"))
    return rows.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
