"""Main text of web pages by consensus of a host's pages.

Every page's containers are scored by the text they hold outside menus, adverts, forms and the like.  Each
page votes for the path of its best container, a path of tag and class names without digits.  The votes are
counted per host in Spark; the pages of a host are then extracted anew at the winning path.  A page
without such a container uses its own best one.

A null page is empty; a page whose containers hold no text gives an empty text.  Pages without a readable
host share one vote.  Repeated rows vote and are extracted like others; ties go to the path that sorts last.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sceneframe.llm.common import settle, thin
from sceneframe.operators.scale import broadcast_if_small

#: elements that never hold main text, and those whose content is not markup
_OUTSIDE = {"nav", "header", "footer", "aside", "form", "button", "select", "iframe", "object", "svg", "canvas", "noscript",
            "template", "menu", "dialog", "head", "script", "style", "title", "textarea"}
_RAW = {"script", "style", "title", "textarea", "noscript", "iframe"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CONTAINERS = {"article", "main", "section", "div", "td", "body"}
_BLOCKS = _CONTAINERS | _OUTSIDE - {"button", "select"} | {
    "html", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "table", "tr", "th",
    "tbody", "thead", "tfoot", "caption", "figure", "figcaption", "address", "hr", "center", "details", "summary", "fieldset"}
#: an opening tag that ends an open element, and what it can't reach across
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_WALLS = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "html", "blockquote"}
#: words of class and id names that mark an element as outside of the main text, or as holding it
_MINOR = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo|banner|cookies?|consent|gdpr|notices?|popup|modal|"
                    r"newsletter|subscribe|sidebar|side|rail|nav|navbar|navigation|menu|breadcrumbs?|footer|header|masthead|share|sharing|social|related|"
                    r"recommended|comments?|disqus|respond|replies|login|signup|widget|toolbar|pagination|skip)(?:$|[\s_-])", re.I)
_MAJOR = re.compile(r"(?:^|[\s_-])(?:article|content|entry|main|post|story|text|body)(?:$|[\s_-])", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS = re.compile(r"\d+")


def _tag_end(page: str, at: int) -> int:
    """Place of the `>` that ends the tag beginning at ``at``, beyond quoted values; -1 if there is none."""
    while True:
        close = page.find(">", at)
        if close < 0:
            return -1
        piece = page[at:close]
        quotes = sorted(q for q in ((piece.find('="'), '"'), (piece.find("='"), "'")) if q[0] >= 0)
        if not quotes:
            return close
        begin = at + quotes[0][0] + 2
        end = page.find(quotes[0][1], begin)
        if end < 0:
            return close
        at = end + 1


class Page:
    """Blocks of main text and scored containers of one page."""

    def __init__(self, page: str):
        self.blocks: list[str] = []
        self.nodes: list[list] = []            # containers: path, score, first block, end block
        self._stack: list[tuple] = [("", "", False, -1)]     # tag, path, outside, container number
        self._text: list[str] = []
        self._linked = 0
        self._links = 0
        self._read(page)
        self._close_to(1)

    def _flush(self) -> None:
        if self._text:
            block = " ".join(html.unescape("".join(self._text)).split())
            if block:
                weight = max(0, len(block) - 2 * self._linked)
                share = 1.0
                for *_, number in reversed(self._stack):
                    if number >= 0:
                        self.nodes[number][1] += share * weight
                        share /= 2
                        if share < 0.4:
                            break
                self.blocks.append(block)
        self._text, self._linked = [], 0

    def _close_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            tag, _, _, number = self._stack[-1]
            if tag in _BLOCKS:
                self._flush()
            if tag == "a":
                self._links -= 1
            if number >= 0:
                self.nodes[number][3] = len(self.blocks)
            self._stack.pop()

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "p" or tag in _BLOCKS and tag not in _ENDS:
            reach = {"p"}
        else:
            reach = _ENDS.get(tag, ())
        if reach:
            for depth in range(len(self._stack) - 1, 0, -1):
                if self._stack[depth][0] in reach:
                    self._close_to(depth)
                    break
                if self._stack[depth][0] in _WALLS:
                    break
        if tag in _BLOCKS:
            self._flush()
        if tag in _VOID:
            if tag == "br":
                self._text.append(" ")
            return
        names = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        label = f"{names.get('class', '')} {names.get('id', '')} {names.get('role', '')}"
        _, path, outside, _ = self._stack[-1]
        outside = outside or tag in _OUTSIDE or tag not in ("html", "body") and bool(_MINOR.search(label))
        step = ".".join([tag, *sorted(_DIGITS.sub("", c) for c in names.get("class", "").split())])
        path = path if tag in ("html", "body") else f"{path}/{step}"       # pages may leave these two out
        number = -1
        if tag in _CONTAINERS and not outside:
            number = len(self.nodes)
            bonus = 1.5 if tag in ("article", "main") else 1.25 if _MAJOR.search(label) else 1.0
            self.nodes.append([path or "/", 0.0, len(self.blocks), len(self.blocks), bonus])
        if tag == "a":
            self._links += 1
        self._stack.append((tag, path, outside, number))

    def _say(self, text: str) -> None:
        if text and not self._stack[-1][2]:
            self._text.append(text)
            if self._links:
                self._linked += len(text)

    def _read(self, page: str) -> None:
        at = 0
        while True:
            mark = page.find("<", at)
            if mark < 0:
                self._say(page[at:])
                return
            self._say(page[at:mark])
            after = page[mark + 1:mark + 2]
            if page.startswith("<!--", mark):
                end = page.find("-->", mark + 4)
                if end < 0:
                    return
                at = end + 3
            elif after in ("!", "?"):
                end = page.find(">", mark)
                if end < 0:
                    return
                at = end + 1
            elif after == "/" or after.isalpha() and after.isascii():
                name = _NAME.match(page, mark + 1 + (after == "/"))
                end = _tag_end(page, mark)
                if end < 0:
                    return                               # a tag cut off by the end of the page
                at = end + 1
                if name is None:
                    continue
                tag = name[0].lower()
                if after == "/":
                    depth = next((d for d in range(len(self._stack) - 1, 0, -1) if self._stack[d][0] == tag), 0)
                    if depth:
                        self._close_to(depth)
                    continue
                self._open(tag, page[name.end():end])
                if tag in _RAW:
                    close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                    if close is None:
                        return
                    at = close.start()
            else:
                self._say("<")
                at = mark + 1

    def best(self) -> tuple[str, float]:
        """Path and score of the best container; an empty path if none holds text."""
        top = max(self.nodes, key=lambda n: n[1] * n[4], default=None)
        return (top[0], top[1] * top[4]) if top is not None and top[1] > 0 else ("", 0.0)

    def text(self, path: str | None) -> str:
        """The blocks below the containers of a path, or below the best one if the path holds none."""
        ranges = [n for n in self.nodes if n[0] == path and n[3] > n[2]]
        if not ranges:
            own = self.best()[0]
            ranges = [n for n in self.nodes if own and n[0] == own and n[3] > n[2]]
        parts, done = [], 0
        for _, _, first, end, _ in sorted(ranges, key=lambda n: n[2]):
            parts += self.blocks[max(first, done):end]
            done = max(done, end)
        return "\n\n".join(parts)


def _vote(batches):
    for batch in thin(batches):
        found = [Page(h or "").best() for h in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in found], pa.string()),
                                          pa.array([s for _, s in found], pa.float64())], names=["host", "path", "score"])


def _extract(batches):
    for batch in thin(batches):
        paths, pages = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        texts = [Page(h or "").text(p) for p, h in zip(paths, pages)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                          pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_paths(pages: DataFrame) -> DataFrame:
    """``(host, path)``: each host's winning path, by pages, then score."""
    votes = pages.select(_host().alias("host"), "html").mapInArrow(_vote, "host string, path string, score double")
    counted = (votes.where("path <> ''").groupBy("host", "path")
               .agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("score", 1).cast("decimal(20,1)")).alias("score")))
    return counted.groupBy("host").agg(F.max(F.struct("n", "score", "path")).alias("top")).select("host", "top.path")


def _host():
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def main_text(pages: DataFrame) -> DataFrame:
    """op5: ``page_id``, ``url``, ``text``, ``n_chars`` of every page."""
    winners = broadcast_if_small(settle(host_paths(pages)), text_columns=("host", "path"))
    placed = pages.select("page_id", "url", "html", _host().alias("host")).join(winners, "host", "left")
    return placed.select("page_id", "url", "path", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
