"""Main text of web pages by composite text density.

A page becomes a tree in which every node knows the characters, tags, link characters and link tags
below it. A node's composite density is its characters per tag, scaled by how far its links are outweighed;
a node's density sum is that of its children. The node with the greatest sum holds the article; the least
density on its path to the body is the threshold. Subtrees elsewhere that reach the threshold are content too, by
their own greatest sum. Within content, a block of several links that doesn't reach the threshold and whose text is
mostly links is a menu and goes. What belongs to an article but is too short for densities stays with it: the
rest of an ``article`` or ``main`` around the greatest sum, and headings and paragraphs beside its path.

Elements that are boilerplate by their tag, role or name (menus, banners, adverts, notices, forms,
reader comments and the like) are left out before densities are computed. A class or an id names boilerplate only as a
whole: ``ad-slot`` or ``related-posts`` do, ``related-work`` doesn't.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements never part of an article.
DROPPED = frozenset("script style noscript iframe template svg canvas object embed audio video map head title nav aside footer form fieldset button select textarea input label dialog menu frameset noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words that name boilerplate, and words that may stand beside them in a class or an id that does.
NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion promoted banner cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup paywall sidebar sidebars aside rail menu menus navbar nav navigation breadcrumb breadcrumbs topbar toolbar masthead header footer comment comments commentlist disqus respond responses reply replies related recommended recommendations share sharing social popup modal overlay widget widgets pagination pager login search skip".split())
BESIDE_NAMES = frozenset("site page global main primary secondary left right top bottom inner outer upper lower area section box block wrap wrapper container content list item items slot unit text bar panel group posts post articles stories links buttons form tags icons js the of and 1 2 3".split())
#: Elements too small to be boilerplate by name inside an article, and those that stay beside the path to the greatest sum.
TEXTS = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre li dt dd b strong i em u s a span code q cite small sub sup mark abbr time td th tr tbody".split())
BESIDE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
#: Names that inside an article may hold its title, and those that make an article element itself boilerplate.
HEADING_NAMES = frozenset("header masthead banner".split())
ARTICLE_NAMES = frozenset("comment comments reply ad advert sponsored promo related".split())
#: A start tag closes these open elements, up to the nearest element of the second set.
_P_ENDERS = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that hold an article.
HOMES = frozenset(("article", "main"))
_KEPT = frozenset(("html", "body", "main", "article"))


def _names(word: str, names: frozenset) -> bool:
    """Whether a class or an id as a whole names boilerplate."""
    parts = [x for x in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", word).lower()) if x]
    return any(x in names for x in parts) and all(x in names or x in BESIDE_NAMES for x in parts)


class Page:
    """The tree of one page, in parallel lists by node; node 0 is the root."""

    def __init__(self, html: str):
        self.tags, self.parents, self.dropped, self.items = ["#root"], [-1], [False], []
        # the open nodes, where each tag and the blocks among them stand, and how many of them are articles
        self.stack, self.places, self.blocks, self.articles = [0], {}, [], 0
        end, position = len(html), 0
        while position < end:
            found = _TOKEN.search(html, position)
            text = html[position : found.start() if found else end]
            if text:
                self.items.append((self.stack[-1], text))
            if not found:
                break
            position = found.end()
            tag = found[2]
            if not tag:
                continue
            tag = tag.lower()
            if found[1]:
                self._close(tag)
                continue
            node = self._open(tag, found[3])
            if tag in RAW:
                close = re.compile(f"</{tag}[^>]*(?:>|\\Z)", re.I).search(html, position)
                position = close.end() if close else end  # nothing inside is main text
            elif tag not in VOID and not found[3].endswith("/"):
                self.places.setdefault(tag, []).append(len(self.stack))
                if tag in BLOCKS:
                    self.blocks.append(len(self.stack))
                self.articles += tag in HOMES
                self.stack.append(node)

    def _last(self, tags: Iterable[str]) -> int:
        """Where the innermost open element with one of these tags stands; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _cut(self, at: int) -> None:
        while len(self.stack) > at:
            tag = self.tags[self.stack.pop()]
            self.places[tag].pop()
            self.articles -= tag in HOMES
            if tag in BLOCKS:
                self.blocks.pop()

    def _close(self, tag: str) -> None:
        at = self._last((tag,))
        if at and tag in BLOCKS:
            self.items.append((self.stack[at], None))
            self._cut(at)
        elif at and (not self.blocks or self.blocks[-1] < at):  # else a stray end of an inline element
            self._cut(at)
        elif tag == "p":
            self.items.append((self.stack[-1], None))

    def _open(self, tag: str, attributes: str) -> int:
        if tag in _P_ENDERS and self.blocks and self.tags[self.stack[self.blocks[-1]]] == "p" and self._last(("button",)) < self.blocks[-1]:
            self._cut(self.blocks[-1])
        if tag in _CLOSES:
            ended, limit = (self._last(tags) for tags in _CLOSES[tag])
            if ended > limit:
                self._cut(ended)
        node = len(self.tags)
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.dropped.append(self._boilerplate(tag, attributes))
        if tag in BLOCKS:
            self.items.append((node, None))
        elif tag == "br":
            self.items.append((self.stack[-1], " "))
        return node

    def _boilerplate(self, tag: str, attributes: str) -> bool:
        if tag in DROPPED:
            return True
        if tag == "header" and not self.articles:
            return True
        if not attributes or tag in ("html", "body", "main"):
            return False
        values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or values.get("role", "").lower() in ROLES:
            return True
        if "display:none" in values.get("style", "").lower().replace(" ", ""):
            return True
        if tag in TEXTS and self.articles:
            return False
        names = NAMES
        if tag == "article":
            names = ARTICLE_NAMES
        elif self.articles:
            names = NAMES - HEADING_NAMES
        return any(_names(word, names) for word in f"{values.get('class', '')} {values.get('id', '')}".split())

    def main_text(self) -> str:
        """The text of the content subtrees, blocks joined by line ends."""
        n = len(self.tags)
        holds = [t in HOMES for t in self.tags]
        for i in range(n - 1, 0, -1):
            if holds[i] and not self.dropped[i]:
                holds[self.parents[i]] = True
        out = [False] * n  # whether the node or one above it is boilerplate
        for i in range(1, n):
            # a wrapper named after its side bar still holds the article
            own = self.dropped[i] and not (holds[i] and self.tags[i] not in DROPPED and self.tags[i] not in _KEPT)
            out[i] = out[self.parents[i]] or own
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        linked = [False] * n
        for i in range(1, n):
            linked[i] = linked[self.parents[i]] or self.tags[i] == "a"
        for node, text in self.items:
            if text is not None and not out[node]:
                size = len("".join(text.split()))
                chars[node] += size
                if linked[node]:
                    link_chars[node] += size
        for i in range(n - 1, 0, -1):
            if not out[i]:
                p = self.parents[i]
                chars[p] += chars[i]
                link_chars[p] += link_chars[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (self.tags[i] == "a")
        if not chars[0]:
            return ""
        body = next((i for i in range(n) if self.tags[i] == "body"), 0)
        share = link_chars[body] / max(1, chars[body])
        density, sums, leaf = [0.0] * n, [0.0] * n, [True] * n
        for i in range(n - 1, -1, -1):
            if not out[i] and chars[i]:
                c, lc = chars[i], link_chars[i]
                base = log(c / max(1, c - lc) * lc + share * c + e)
                density[i] = c / max(1, tags[i]) * max(0.0, log(c / max(1, lc) * max(1, tags[i]) / max(1, link_tags[i]))) / max(log(base), 1e-9) if base > 1 else 0.0
            if leaf[i]:
                sums[i] = density[i]
            if i and not out[i]:
                p = self.parents[i]
                if leaf[p]:
                    leaf[p], sums[p] = False, 0.0
                sums[p] += density[i]
        best = max(range(n), key=lambda i: (sums[i] if chars[i] and not out[i] else -1.0, chars[i], -i))
        path, node = [], best
        while node >= 0:
            path.append(node)
            node = self.parents[node] if node != body else -1
        threshold = min(density[i] for i in path)
        content, above = [False] * n, set(path)
        content[next((i for i in reversed(path) if self.tags[i] in HOMES), best)] = True
        inside = [(sums[i], i) for i in range(n)]  # the greatest sum at or below each node
        for i in range(n - 1, 0, -1):
            if not out[i]:
                inside[self.parents[i]] = max(inside[self.parents[i]], inside[i])
        for i in range(n):
            if out[i] or not chars[i] or i in above:
                continue
            if density[i] >= threshold:
                content[inside[i][1]] = True
            elif self.tags[i] in BESIDE and self.parents[i] in above and 2 * link_chars[i] <= chars[i] and (self.parents[i] != body or (self.tags[i] == "h1" and i < best)):
                content[i] = True
        for i in range(1, n):
            menu = self.tags[i] in BLOCKS and link_tags[i] > 1 and 2 * link_chars[i] > chars[i] and density[i] < threshold and i not in above
            content[i] = (content[i] or content[self.parents[i]]) and not out[i] and not menu
        return self._joined(content)

    def _joined(self, content: list[bool]) -> str:
        blocks: list[str] = []
        now: list[str] = []
        for node, text in self.items:
            if text is None:
                if now:
                    blocks.append(" ".join("".join(now).split()))
                    now = []
            elif content[node]:
                now.append(unescape(text) if "&" in text else text)
        if now:
            blocks.append(" ".join("".join(now).split()))
        return "\n".join(b for b in blocks if b)


def main_text(html: str) -> str:
    """The main text of one page; empty if there is none."""
    return Page(html).main_text() if html else ""


def _extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page.

    Columns: ``page_id``, ``url``, ``text`` (blocks in page order joined by a line end, white space inside a
    block as one space, character references decoded) and ``n_chars`` (its code points). Null and empty
    pages, and pages without main text, give the empty text; null ids and repeated rows stay; markup may be
    broken or cut off anywhere; an empty table gives no rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"))
    return rows.mapInArrow(_extracted, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
