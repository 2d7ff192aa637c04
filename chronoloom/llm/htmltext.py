"""Main text of web pages by composite text density.

A tolerant parser builds the page's tree; elements that are no article text by their
nature (navigation, headers, footers, asides, forms, scripts, hidden ones, reader
comments) are set aside.  For every remaining node the composite density weighs characters
for each tag by the share of link characters and link tags; a node's density sum is that of
its children.  The node of the largest sum is the core of the article, and the least
density on its path up to the body is the threshold: on every page, at any depth, the
densest part of whatever reaches it is content as well.  Headings before content and
blocks between contents belong to it, unless they consist mostly of links; an <article>, or
else a <main>, around the core is content as a whole.

Elements whose class or id names an advert, a notice and the like are set aside too, before
densities are summed; one that holds block elements and a larger sum than all the rest is
taken for a page's wrapper instead.

Defined results: a null, empty or tagless page is handled like any other (its text is
what remains after the rules, possibly empty); unclosed and stray tags are repaired;
repeated rows each give a row; nothing is cut off, however long; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import require

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/><]*)", re.S)
_STOP = re.compile("[\"'>]")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noscript iframe noframes".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_ENDS_P = _BLOCK - {"br", "body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend"}
#: An element that a start tag closes when open, up to the barrier.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
_DROP = frozenset("head script style noscript template nav header footer aside form iframe svg math button select textarea title object embed canvas audio video map dialog menu fieldset label noframes xmp".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_INLINE = frozenset("p b i a span em strong".split())
#: What an inline end tag doesn't reach out of.
_HOLDS = frozenset("article body td table".split())
_WHOLE = frozenset("html body main article".split())
#: Words of class and id that name what is no article text.
_NAMES = re.compile(r"ads?|adv|advert\w*|adsby\w*|adsense|adslot|adbox|alert\w*|announcements?|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|notification\w*|newsletter|subscri\w*|signup|login|sidebar\w*|menu\w*|nav|navbar|navigation|navi|breadcrumbs?|share|sharing|social\w*|related\w*|recommend\w*|footer\w*|header\w*|masthead|popup|modal|overlay|paywall|toast|toolbar|pagination|pager|widget\w*|search\w*|disclaimer|copyright|skip|toc|tags|outbrain|taboola")
_COMMENTS = re.compile(r"comments?|commentlist|disqus\w*|feedback|guestbook|replies|reply|respond|discussion|reviews?")
_WORD = re.compile(r"[a-z]+")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}


class Page:
    """Nodes in page order (tag, parent, whether set aside) and events: (node, text), or (node, None) for a block's border."""

    def __init__(self, html: str):
        self.tag, self.parent, self.drop, self.soft = ["#root"], [0], [False], [False]
        self.events: list[tuple[int, str | None]] = []
        #: For each name, the places in the stack where it is open.
        self.opened: dict[str, list[int]] = defaultdict(list)
        self.html, self.unclosed = html, set()
        stack = [0]
        at, end = 0, len(html)
        while at < end:
            m = _TAG.search(html, at)
            close = m.end() if m and not m[2] else self._tag_end(m.end()) if m else -1
            start = m.start() if close >= 0 else end
            if start > at:
                self.events.append((stack[-1], html[at:start]))
            if close < 0:  # no tag ends any more
                break
            at = close
            if not m[2]:
                if m[0].startswith("<![CDATA["):
                    self.events.append((stack[-1], m[0][9:].removesuffix("]]>").replace("&", "&amp;")))
                continue
            name = m[2].lower()
            if m[1]:
                self._close(stack, name)
                continue
            self._open(stack, name, html[m.end() : at - 1])
            if name in _RAW:
                shut = re.compile(rf"</{re.escape(name)}\s*/?>", re.I).search(html, at)
                at = shut.end() if shut else end
                self._leave(stack)
            elif name in _VOID:
                self._leave(stack)

    def _tag_end(self, at: int) -> int:
        """Where the tag ends whose attributes begin here; quotes that never pair up are taken as they are."""
        html, path, x = self.html, [], at
        first = html.find(">", at)
        if first < 0:
            return -1
        while x not in self.unclosed:
            m = _STOP.search(html, x)
            if m and m[0] == ">":
                return m.end()
            path.append(x)
            x = html.find(m[0], m.end()) + 1 if m else 0
            if not x:
                break
        self.unclosed.update(path)  # whoever comes here again fails as well
        return first + 1

    def _open(self, stack: list[int], name: str, raw: str) -> None:
        tags = self.tag
        if name in _ENDS_P:
            self._shut(stack, {"p"}, {"table", "td", "th", "button", "article", "div", "section", "li", "blockquote"} if name != "p" else {"table", "td", "th", "button"})
        if name in _CLOSES:
            self._shut(stack, *_CLOSES[name])
        node, up = len(tags), stack[-1]
        drop = soft = False
        if raw.strip(" /"):
            a = _attributes(raw)
            names = _WORD.findall(f"{a.get('class', '')} {a.get('id', '')}".lower())
            drop = "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in _ROLES or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I))
            if name not in _WHOLE:
                drop |= any(_COMMENTS.fullmatch(x) for x in names)
                soft = any(_NAMES.fullmatch(x) for x in names)
            else:
                drop = False
        tags.append(name)
        self.parent.append(up)
        self.drop.append(drop or name in _DROP)
        self.soft.append(soft)
        if name in _BLOCK:
            self.events.append((node, None))
        self.opened[name].append(len(stack))
        stack.append(node)

    def _leave(self, stack: list[int]) -> None:
        self.opened[self.tag[stack.pop()]].pop()

    def _last(self, names: Iterable[str]) -> int:
        return max((self.opened[t][-1] for t in names if self.opened[t]), default=0)

    def _shut(self, stack: list[int], names: Iterable[str], barrier: Iterable[str]) -> None:
        i = self._last(names)
        if i > self._last(barrier):
            self._pop(stack, i)

    def _close(self, stack: list[int], name: str) -> None:
        self._shut(stack, (name,), _HOLDS if name in _INLINE else ())

    def _pop(self, stack: list[int], i: int) -> None:
        while len(stack) > i:
            if self.tag[stack[-1]] in _BLOCK:
                self.events.append((stack[-1], None))
            self._leave(stack)

    def _lengths(self) -> tuple[list[int], list[tuple[int, str | None]]]:
        """Visible characters of each node's own text, and the events with character references decoded."""
        own = [0] * len(self.tag)
        texts: list[tuple[int, str | None]] = []
        for node, raw in self.events:
            if raw is not None:
                raw = unescape(raw) if "&" in raw else raw
                own[node] += len(raw) - sum(map(len, _SPACE.findall(raw)))
            texts.append((node, raw))
        return own, texts

    def densities(self, own: list[int], gone: list[bool]) -> tuple[list[float], list[float], list[float]]:
        """Each node's composite density and density sum, and the share of its characters in links."""
        tag, parent, n = self.tag, self.parent, len(self.tag)
        live = [i for i in range(1, n) if not gone[i]]
        c, t, lc, lt, in_link = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [False] * n
        for i in live:
            in_link[i] = in_link[parent[i]] or tag[i] == "a"
        for i in [*reversed(live), 0]:
            c[i] += own[i]
            lc[i] += own[i] if in_link[i] else 0
            if i:
                p = parent[i]
                c[p] += c[i]
                lc[p] += lc[i]
                t[p] += t[i] + 1
                lt[p] += lt[i] + (tag[i] == "a")
        body = self._body(gone)
        share = lc[body] / c[body] if c[body] else 0.0
        density = [0.0] * n
        for i in (*live, 0):
            if c[i]:
                base = math.log(c[i] / max(1.0, c[i] - lc[i]) * lc[i] + share * c[i] + math.e)
                odds = c[i] / max(1.0, lc[i]) * max(1.0, t[i]) / max(1.0, lt[i])
                density[i] = c[i] / max(1.0, t[i]) * max(0.0, math.log(odds) / max(1.0, math.log(base) + 1))
        total, up = [0.0] * n, parent[:]
        for i in live:  # inline elements are part of the block that they are in
            up[i] = parent[i] if parent[i] == 0 or tag[parent[i]] in _BLOCK else up[parent[i]]
            if tag[i] in _BLOCK:
                total[up[i]] += density[i]
        for i in (*live, 0):  # a block of text alone is its own only part
            if c[i] and not total[i] and (i == 0 or tag[i] in _BLOCK):
                total[i] = density[i]
        return density, total, [x / y if y else 0.0 for x, y in zip(lc, c, strict=True)]

    def _body(self, gone: list[bool]) -> int:
        return next((i for i in range(1, len(gone)) if self.tag[i] == "body" and not gone[i]), 0)

    def _below(self, marks: list[bool]) -> list[bool]:
        """Which nodes are marked or lie in a marked one."""
        for i in range(1, len(marks)):
            marks[i] = marks[i] or marks[self.parent[i]]
        return marks

    def core(self, gone: list[bool], total: list[float]) -> int:
        """The node of the body with the largest density sum, the first of equals."""
        inside = self._body(gone)
        held = self._below([i == inside for i in range(len(gone))])
        return max((i for i in range(len(gone)) if held[i] and not gone[i]), key=lambda i: (total[i], -i), default=inside)

    def article(self, gone: list[bool], density: list[float], total: list[float], links: list[float]) -> list[bool]:
        """Which nodes make up the article."""
        tag, parent, n = self.tag, self.parent, len(self.tag)
        body, top = self._body(gone), self.core(gone, total)
        # The largest density sum of each subtree: the node that has it.
        best = list(range(n))
        for i in range(n - 1, 0, -1):
            p = parent[i]
            if not gone[i] and total[best[i]] > total[best[p]]:
                best[p] = best[i]
        path, i = {top}, top
        while i != body and i:
            i = parent[i]
            path.add(i)
        least = min(density[i] for i in path)
        held = self._below([i == body for i in range(n)])
        # An <article>, or else a <main>, around the core is taken whole.
        up, i = [], top
        while i != body and i:
            up.append(i)
            i = parent[i]
        top = next((j for kind in ("article", "main") for j in reversed(up) if tag[j] == kind), top)
        core = self._below([i == top for i in range(n)])
        dense = {best[i] for i in range(n) if held[i] and not gone[i] and i not in path and not core[i] and density[i] >= max(least, 1e-9)}
        content = self._below([i == top or i in dense for i in range(n)])
        # How many contents each subtree holds, and where it ends.
        count, end = [int(i == top or i in dense) for i in range(n)], list(range(n))
        for i in range(n - 1, 0, -1):
            count[parent[i]] += count[i]
            end[parent[i]] = max(end[parent[i]], end[i])
        marked = [i for i in range(n) if i == top or i in dense]
        first, last = marked[0], max(end[i] for i in marked)
        taken = [False] * n
        for i in range(n):
            if gone[i] or (i and not taken[parent[i]]):
                continue
            between = (first < i <= last or tag[i] in _HEADINGS) and not (tag[i] in _BLOCK and links[i] > 0.5)
            inline = i and tag[i] not in _BLOCK and tag[parent[i]] != "body"
            taken[i] = bool(content[i] or count[i] or between or inline)
        return taken

    def main_text(self) -> str:
        tag, parent, n = self.tag, self.parent, len(self.tag)
        own, texts = self._lengths()
        hard = self._below(self.drop[:])
        blocks_in = [0] * n
        for i in range(n - 1, 0, -1):
            blocks_in[parent[i]] += blocks_in[i] + (tag[i] in _BLOCK and not hard[i])
        # A name sets its element aside, unless that holds blocks and the core of all the page.
        i, spared = self.core(hard, self.densities(own, hard)[1]), set()
        while i:
            if self.soft[i] and blocks_in[i]:
                spared.add(i)
            i = parent[i]
        gone = self._below([hard[i] or (self.soft[i] and i not in spared) for i in range(n)])
        content = self.article(gone, *self.densities(own, gone))
        blocks, part = [], []
        for node, raw in [*texts, (0, None)]:
            if raw is None:
                line = _SPACE.sub(" ", "".join(part)).strip()
                if line:
                    blocks.append(line)
                part = []
            elif content[node]:
                part.append(raw)
        return "\n".join(blocks)


def main_text(html: str | None) -> str:
    return Page(html or "").main_text()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row."""
    require(pages, "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
