"""Main text of web pages by composite text density.

A page becomes a tree of elements.  Each element has a density, its characters per tag,
adjusted by how many of both are in links, and a sum, the densities of its children.  The
element with the greatest sum holds the main text; the least density on the path from the
body to it is the threshold under which other parts of the page are left out.  Parts that
name themselves as something else (menus, footers, adverts, forms, comments, ...) are
taken out of the tree before that.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from linkhop.llm.common import documents, frugal, prepare

#: Elements of HTML by what they do to the tree and the text.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
    "li listing main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
#: Those that end an open paragraph, and how far an end is looked for.
ENDS_P = BLOCK - frozenset("body caption head html legend optgroup option tbody td tfoot th thead tr".split())
SCOPE = frozenset("button caption html marquee object table td th template".split())
#: Those that end an open one of a kind when they begin, up to an element that holds them.
ENDS = {
    "li": ({"li"}, {"ol", "ul", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
#: Open elements that an end is looked for in, as deep as browsers nest them.
DEPTH = 512
#: Elements that hold no text of an article, wherever they are, ...
NEVER = frozenset("script style head title template noscript iframe noembed noframes object embed applet audio video canvas svg math map select option optgroup datalist textarea button input dialog menu nav aside search".split())
#: ... outside of articles, ...
OUTSIDE = frozenset("header footer".split())
#: ... and what ids, classes and roles call such parts.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adsense adslot adbox adsbox sponsor sponsored sponsors promo promos promotion banner banners outbrain taboola "
    "nav navbar navigation navi menu menus topbar toolbar breadcrumb breadcrumbs pagination pager skip "
    "sidebar sidebars aside rail widget widgets complementary related recommended recommendations "
    "footer footnav colophon contentinfo masthead siteheader header "
    "cookie cookies consent gdpr notice notices notification notifications alert alertdialog popup modal overlay dialog newsletter subscribe subscription signup login paywall "
    "comment comments commentlist commentary disqus respond replies reply reviews social share sharing form search searchform".split()
)
HEADED = frozenset("header banner".split())
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_WORDS = re.compile(r"[a-z]+")
_CASES = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _own_name(tag: str, attributes: str) -> tuple[bool, frozenset]:
    """Whether an element is hidden, and the words of its id, classes and role."""
    hidden, words = False, []
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("id", "class", "role"):
            for one in value.split():
                words += _WORDS.findall(_CASES.sub(" ", one).lower())
        elif name == "hidden" or name == "style" and _HIDDEN.search(value):
            hidden = True
    return hidden, frozenset(words)


class Page:
    """The tree of a page: elements in page order, element 0 above all, and the pieces of text with their element and block."""

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.hidden, self.names = ["#page"], [-1], [False], [frozenset()]
        self.pieces: list[tuple[int, int, str]] = []
        self._block = 0
        self._stack, self._open = [0], {}
        self._read(source)
        n = len(self.tags)
        self.ends = list(range(1, n + 1))  # one past the last element inside
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            if self.ends[i] > self.ends[p]:
                self.ends[p] = self.ends[i]

    def _push(self, tag: str, attributes: str) -> None:
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        hidden, names = _own_name(tag, attributes) if attributes and not attributes.isspace() else (False, frozenset())
        self.hidden.append(hidden)
        self.names.append(names)
        if tag in BLOCK:
            self._block += 1
        elif tag == "br":  # white space inside a block
            self.pieces.append((len(self.tags) - 1, self._block, " "))
        if tag not in VOID:
            self._stack.append(len(self.tags) - 1)
            self._open[tag] = self._open.get(tag, 0) + 1

    def _pop(self) -> str:
        tag = self.tags[self._stack.pop()]
        self._open[tag] -= 1
        if tag in BLOCK:
            self._block += 1
        return tag

    def _close(self, kinds, holders) -> None:
        """Ends the innermost open element of these kinds unless one of the holders is nearer."""
        if not any(self._open.get(k) for k in kinds):
            return
        for at in range(len(self._stack) - 1, max(0, len(self._stack) - 1 - DEPTH), -1):
            tag = self.tags[self._stack[at]]
            if tag in kinds:
                while len(self._stack) > at:
                    self._pop()
                return
            if tag in holders:
                return

    def _begin(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self._open.get(tag):
            return
        if tag in ENDS_P:
            self._close({"p"}, SCOPE)
        if tag in ENDS:
            self._close(*ENDS[tag])
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.tags[self._stack[-1]] in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._pop()
        if tag == "a":  # links don't nest
            self._close({"a"}, SCOPE)
        self._push(tag, attributes)

    def _end(self, tag: str) -> None:
        if tag in ("html", "body") or not self._open.get(tag):
            return
        # an inline element doesn't end blocks
        self._close({tag}, {"table", "td", "th"} - {tag} if tag in BLOCK else BLOCK)

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append((self._stack[-1], self._block, html.unescape(text)))

    def _read(self, source: str) -> None:
        at, low = 0, None
        while (less := source.find("<", at)) >= 0:
            if source.startswith("<!--", less):
                self._text(source[at:less])
                end = source.find("-->", less + 2)
                at = len(source) if end < 0 else end + 3
                continue
            m = _TAG.match(source, less) or _PLAIN.match(source, less)
            if m:
                self._text(source[at:less])
                at, tag = m.end(), m[2].lower()
                if m[1]:
                    self._end(tag)
                    continue
                self._begin(tag, m[3])
                if tag in RAW:
                    low = low if low is not None else source.lower()
                    if len(low) != len(source):  # a letter that lower() spells in two
                        low = re.sub("[A-Z]", lambda x: x[0].lower(), source)
                    end = low.find(f"</{tag}", at)
                    end = len(source) if end < 0 else end
                    if tag == "textarea" or tag == "title":
                        self._text(source[at:end])
                    at = end
                continue
            following = source[less + 1 : less + 2]
            if following in ("!", "?", "/"):  # what no browser shows
                self._text(source[at:less])
                end = source.find(">", less)
                at = len(source) if end < 0 else end + 1
            elif following.isascii() and following.isalpha():  # a tag that the page ends in
                self._text(source[at:less])
                at = len(source)
            else:
                self._text(source[at : less + 1])
                at = less + 1
        self._text(source[at:])


def boilerplate(page: Page, named: bool) -> list[bool]:
    """Which elements hold no text of an article, by kind and, if named, by what they are called."""
    n = len(page.tags)
    # articles and headings, and paragraphs, up to each element
    kept = [0, *accumulate(tag in ("article", "main", "h1") for tag in page.tags)]
    has_paragraph = [0, *accumulate(tag in ("p", "article", "main") for tag in page.tags)]
    out, inside = [False] * n, [False] * n
    for i in range(1, n):
        p = page.parents[i]
        inside[i] = inside[p] or page.tags[i] in ("article", "main")
        out[i] = out[p]
        if out[i] or page.tags[i] in ("html", "body", "article", "main"):
            continue
        tag, names, whole = page.tags[i], page.names[i], kept[page.ends[i]] > kept[i + 1]
        if tag in NEVER or page.hidden[i] or tag in OUTSIDE and not (inside[i] and (tag == "header" or whole)):
            out[i] = not (tag == "header" and inside[i])
        elif tag == "form":
            out[i] = not whole and (named or has_paragraph[page.ends[i]] == has_paragraph[i + 1])
        elif named and not whole and not names.isdisjoint(NAMED):
            # an article's own heading may be called its header
            out[i] = not (inside[i] and names & NAMED <= HEADED)
    return out


class Density:
    """Characters, tags, density and sum of densities of each element that is left."""

    def __init__(self, page: Page, out: list[bool]) -> None:
        n = len(page.tags)
        chars, own, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[page.parents[i]] or page.tags[i] == "a"
        for i, _, text in page.pieces:
            if not out[i]:
                own[i] += len("".join(text.split()))
        for i in range(n - 1, -1, -1):
            chars[i] += own[i]
            if in_link[i]:
                links[i] += own[i]
            if i and not out[i]:
                p = page.parents[i]
                chars[p] += chars[i]
                links[p] += links[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + in_link[i]
        body = next((i for i in range(n) if page.tags[i] == "body"), 0)
        share = links[body] / max(chars[body], 1)
        self.chars, self.links, self.link_tags, self.body = chars, links, link_tags, body
        self.density, self.sums = [0.0] * n, [float(x) for x in own]
        for i in range(n - 1, -1, -1):
            if out[i] or not chars[i]:
                continue
            c, t = chars[i], max(tags[i], 1)
            # links make the base larger and the quotients smaller; e is the least base, so that few links change little
            base = max(math.e, math.log(c / max(c - links[i], 1) * links[i] + share * c + math.e))
            self.density[i] = c / t * math.log(max(c / max(links[i], 1) * t / max(link_tags[i], 1), 1.0), base)
            if i:
                self.sums[page.parents[i]] += self.density[i]


def content(page: Page, out: list[bool], d: Density) -> list[int]:
    """The elements whose subtrees hold the main text, in page order."""
    alive = [i for i in range(d.body, page.ends[d.body]) if not out[i] and d.chars[i]]
    if not alive:
        return []
    densest = lambda some: max(some, key=lambda i: (d.sums[i], -i))
    # an article is whole: where there are any, the outermost one around the best element in them, else the main part
    holder: dict[int, int] = {}
    for kind in ("article", "main"):
        for i in alive:
            p = page.parents[i]
            if p in holder or page.tags[i] == kind:
                holder[i] = holder.get(p, i)
        if holder:
            return [holder[densest(holder)]]
    best = densest(alive)
    path = [best]
    while path[-1] != d.body:
        path.append(page.parents[path[-1]])
    threshold = min(d.density[i] for i in path)
    found = {best}
    above = set(path[1:])
    for i in alive:
        if i == best or i in above or page.parents[i] not in above:
            continue
        if page.tags[i] == "h1" and i < best:  # its heading, though short
            found.add(i)
        elif d.density[i] >= threshold:
            found.add(densest(j for j in range(i, page.ends[i]) if not out[j]))
    return sorted(found)


def link_lists(page: Page, out: list[bool], d: Density) -> list[bool]:
    """out with lists and boxes that are links and little else."""
    more = list(out)
    for i in range(1, len(page.tags)):
        more[i] = more[i] or more[page.parents[i]]
        if not more[i] and page.tags[i] in ("ul", "ol", "dl", "table", "div", "section") and d.link_tags[i] > 1 and 5 * d.links[i] >= 4 * d.chars[i]:
            more[i] = True
    return more


def main_text(source: str | None) -> str:
    """The text of the page's article, its blocks joined by line ends; empty if there is none."""
    page = Page(source or "")
    for named in (True, False):  # a page whose own names leave nothing is judged without them
        out = boilerplate(page, named)
        d = Density(page, out)
        if any(d.links):
            out = link_lists(page, out, d)
            d = Density(page, out)
        spans = [(i, page.ends[i]) for i in content(page, out, d)]
        if spans:
            break
    else:
        return ""
    chosen = [False] * len(page.tags)
    for a, b in spans:
        chosen[a:b] = [True] * (b - a)
    blocks: list[str] = []
    at, held = None, []
    for i, block, text in page.pieces:
        if chosen[i] and not out[i]:
            if block != at and held:
                blocks.append("".join(held))
                held = []
            at = block
            held.append(text)
    blocks.append("".join(held))
    return "\n".join(t for t in (" ".join(b.split()) for b in blocks) if t)


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    text is the page's main text: of each block its words with one space between, blocks
    joined by a line end; empty for a null or empty page or one without text.  Whole pages
    are read, each on its own, so nothing is shuffled; null and repeated ids and rows are
    kept.  Further columns are left out; an empty table gives an empty result.
    """
    prepare(pages.sparkSession)
    kept = documents(pages, id_col, url_col, html_col).toDF("page_id", "url", "html")
    schema = T.StructType([kept.schema["page_id"], kept.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    @frugal
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return kept.mapInArrow(read, schema)
