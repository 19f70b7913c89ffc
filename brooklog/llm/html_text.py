"""Main text of web pages by consensus host paths.

Each page is parsed into blocks. Elements get a generalised path: tag and class of each ancestor, digits made
N; it is kept as a 64-bit hash of the parent's path and the own part. Boilerplate elements count for nothing: by tag or
role, or by a class or id whose words all say so (`ad-box`, `comments-2`). Where only some do (`ad-free-note`) the host decides:
such an element is a fixed notice if at least REPEATS different pages have the same text at its path. A page scores its
containers: the text each holds, less its links' text, over the page's whole; from the deepest container
with at least COVER of it the page climbs to the outermost element that adds only main text (title, lead,
sections beside it), and that path gets the page's vote. Spark sums the votes by host and path; then every
page is extracted again from the elements at its host's winning path, from which it climbs likewise. A
page that has none of these uses its own best container. Boxes that stand beside the winner at page level
are not main text, but for headings before it.

Ties: of containers that hold as much, the deepest and last one starts the climb; of paths with equal votes, the one
with more text, then the larger hash. A page without any text gives the empty text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklog.llm.shared import map_arrow, write_table

#: Share of a page's text that the best container holds, pages that make a repeated text a notice, and the most bytes of host paths that are broadcast.
COVER, REPEATS, MOST_BYTES = 0.85, 3, 16 << 20

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp")}
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[a-z]+")

# fixed lists of HTML names
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"html", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption"}
_CONTAINER = {"#root", "html", "body", "article", "main", "section", "div", "td", "center", "blockquote"}
_PAGE, _MAIN, _BOX, _HEADINGS = {"#root", "html", "body"}, {"article", "main"}, {"div", "td", "center"}, {"h1", "h2", "h3", "h4", "h5", "h6"}
_ENDS_P = _BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_OUT_TAGS = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "object", "canvas", "audio", "video"}
_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar"}
_OUT_WORDS = {
    "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "header", "masthead", "topbar", "footer", "foot", "bottom", "sidebar", "aside", "widget", "widgets",
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "adbox", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay",
    "comment", "comments", "reply", "replies", "respond", "disqus", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "pagination", "pager", "toolbar", "skip", "copyright", "legal",
}
#: Fixed words of layout, which beside a word of _OUT_WORDS don't make a class something else.
_LAYOUT_WORDS = {
    "site", "page", "main", "global", "primary", "secondary", "top", "left", "right", "side", "center", "box", "wrap", "wrapper", "container", "inner", "outer", "holder", "area", "section", "block", "panel", "group", "row", "col", "column",
    "list", "item", "items", "link", "links", "button", "buttons", "btn", "bar", "icons", "form", "content", "body", "slot", "unit", "zone", "post", "posts", "article", "articles", "entry", "story", "stories", "blog", "user", "google", "js", "is", "the", "n", "id",
}
_HEAD_WORDS, _OF_ARTICLES = {"header", "masthead"}, {"post", "article", "entry", "story", "section", "content"}
_SAME_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


def _boilerplate(value: str) -> bool | None:
    """Whether a class or id in lower case names boilerplate; None if only some words of a name do."""
    some = False
    for name in value.split():
        words = set(_WORDS.findall(name))
        found = words & _OUT_WORDS
        if found and not (found <= _HEAD_WORDS and words & _OF_ARTICLES):
            if words <= _OUT_WORDS | _LAYOUT_WORDS:
                return True
            some = True
    return None if some else False


class Page:
    """Elements and text blocks of one page. fixed: paths of the host's notices, which are out."""

    def __init__(self, html: str, fixed: frozenset[int] = frozenset()):
        self.parent, self.tag, self.path, self.out = [-1], ["#root"], [0], [False]
        self.soft: list[int] = []  # elements of which the host decides
        self._fixed, self._open_tags = fixed, {}
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters inside links
        self._stack, self._parts, self._links, self._in_link = [0], [], 0, 0
        at, n = 0, len(html)
        while at < n:
            m = _TOKEN.search(html, at)
            if m is None:
                self._text(html[at:])
                break
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                self._close(name)
            elif name in _RAW_END:
                end = _RAW_END[name].search(html, at)
                at = end.end() if end else n
            else:
                self._open(name, m[3])
        self._flush()

    def _text(self, text: str) -> None:
        if not self.out[self._stack[-1]]:
            text = unescape(text) if "&" in text else text
            self._parts.append(text)
            if self._in_link:
                self._links += len(text)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                own = next(e for e in reversed(self._stack) if self.tag[e] in _BLOCK or e == 0)
                self.blocks.append((own, text, min(self._links, len(text))))
            self._parts, self._links = [], 0

    def _pop_to(self, place: int) -> None:
        if any(self.tag[e] in _BLOCK for e in self._stack[place:]):
            self._flush()
        for e in self._stack[place:]:
            self._in_link -= self.tag[e] == "a"
            self._open_tags[self.tag[e]] -= 1
        del self._stack[place:]

    def _find(self, names: set[str], until: set[str] = frozenset()) -> int:
        if not any(self._open_tags.get(name) for name in names):
            return 0
        for place in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[place]]
            if tag in names:
                return place
            if tag in until:
                return 0
        return 0

    def _open(self, name: str, attributes: str) -> None:
        if name == "br" or name == "wbr":
            self._parts.append(" " if name == "br" else "")
            return
        if name in _ENDS_P and (place := self._find({"p"}, {"td", "th", "div", "article", "section", "body", "li"})):
            self._pop_to(place)
        if name in _SAME_ENDS and (place := self._find(*_SAME_ENDS[name])):
            self._pop_to(place)
        if name in _BLOCK:
            self._flush()
        if name in _VOID or name in ("html",) and len(self._stack) > 1:
            return
        up = self._stack[-1]
        kinds, soft, out = "", False, self.out[up] or name in _OUT_TAGS and not (name == "header" and (self._open_tags.get("article") or self._open_tags.get("main")))
        if attributes and ("=" in attributes or "hidden" in attributes):
            for key, *values in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), "".join(values).lower()
                if key == "class":
                    kinds = "".join("." + _DIGITS.sub("N", c) for c in sorted(value.split()))
                if key in ("class", "id"):
                    named = name not in ("html", "body", "article", "main") and _boilerplate(value)
                    out, soft = out or named is True, soft or named is None
                elif key == "role":
                    out = out or value.strip() in _OUT_ROLES
                else:
                    out = out or key == "hidden" and value in ("", "hidden", "until-found") or value == "true"
        self.parent.append(up)
        self.tag.append(name)
        path = xxhash.xxh3_64_intdigest(f"{self.path[up]}>{name}{kinds}".encode("utf-8", "surrogatepass")) - (1 << 63)
        self.path.append(path)
        self.out.append(out or path in self._fixed)
        if soft and not out:
            self.soft.append(len(self.tag) - 1)
        self._stack.append(len(self.tag) - 1)
        self._open_tags[name] = self._open_tags.get(name, 0) + 1
        self._in_link += name == "a"
        if not attributes.endswith("/") or name in _BLOCK or name == "a":
            return
        self._pop_to(len(self._stack) - 1)

    def _close(self, name: str) -> None:
        if name == "p" and not self._find({"p"}):
            self._flush()
            return
        if place := self._find({name}, {"td", "th", "table"} - {name} if name not in ("table", "tr", "tbody", "thead", "tfoot", "div", "body", "html", "article", "section", "main") else frozenset()):
            self._pop_to(place)

    def _measure(self) -> None:
        """The last element below each, boxes and main elements around each, and each one's blocks."""
        n = len(self.tag)
        self._last, self._boxes, self._mains, self._own = list(range(n)), [0] * n, [0] * n, [[] for _ in range(n)]
        for e in range(1, n):
            up = self.parent[e]
            self._boxes[e] = self._boxes[up] + (self.tag[e] in _BOX)
            self._mains[e] = self._mains[up] + (self.tag[e] in _MAIN)
        for e in range(n - 1, 0, -1):
            self._last[self.parent[e]] = max(self._last[self.parent[e]], self._last[e])
        for e, text, links in self.blocks:
            self._own[e].append(2 * links >= len(text))

    def climb(self, e: int) -> int:
        """The outermost element around e that adds main text only; e itself if none adds text.

        Lists of links outside headings stop the climb, and so do boxes beside it at page level; inside an article or main element
        all counts.
        """
        best = at = e
        while (up := self.parent[at]) >= 0:
            inside, page, adds = self._mains[up] > 0, self.tag[up] in _PAGE, False
            for x in (*range(up, at), *range(self._last[at] + 1, self._last[up] + 1)):
                for linked in self._own[x]:
                    adds = True
                    heading = self.tag[x] in _HEADINGS
                    boxed = page and self._boxes[x] > self._boxes[up] and not (heading and not linked and x < at)
                    if not inside and (linked and not heading or boxed):
                        return best
            at = up
            if adds:
                best = up
        return best

    def notices(self) -> list[tuple[int, int]]:
        """(path, hash of the text) of the elements of which the host decides."""
        if not self.soft:
            return []
        self._measure()
        return [(self.path[e], _text_hash([t for x, t, _ in self.blocks if e <= x <= self._last[e]])) for e in self.soft]

    def best(self) -> tuple[int, int] | None:
        """Path and text weight of the container that the page climbs to from the deepest one with COVER of its text."""
        weight, total = [0] * len(self.tag), 0
        for e, text, links in self.blocks:
            w = max(0, len(text) - 2 * links)
            total += w
            weight[e] += w
        for e in range(len(self.tag) - 1, 0, -1):  # children come after their parents
            weight[self.parent[e]] += weight[e]
        if not total:
            return None
        place = max(e for e in range(len(self.tag)) if self.tag[e] in _CONTAINER and weight[e] >= COVER * total)
        self._measure()
        place = self.climb(place)
        return self.path[place], weight[place]

    def text(self, path: int) -> str | None:
        """The blocks below the elements at path and those they climb to, joined; None if the page has no such element."""
        inside, done = [False] * len(self.tag), -1
        self._measure()
        for e in range(len(self.tag)):  # parents come before their children
            if not self.out[e] and self.path[e] == path and e > done:
                top = self.climb(e)
                done = self._last[top]
                inside[top : done + 1] = [True] * (done + 1 - top)
        if done < 0:
            return None
        return "\n\n".join(t for e, t, _ in self.blocks if inside[e])


def _text_hash(texts: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(texts).encode("utf-8", "surrogatepass")) - (1 << 63)


def extract(html: str | None, path: int | None, fixed: list[int] | None = None) -> str:
    """Main text of one page: by the host's path, else by its own best container, else nothing. fixed: paths of the host's notices."""
    page = Page(html or "", frozenset(fixed or ()))
    found = page.text(path) if path is not None else None
    if not found:
        own = page.best()
        found = page.text(own[0]) if own else "\n\n".join(t for _, t, _ in page.blocks)
    return found or ""


VOTES = "host string, path long, notice boolean, votes long, chars long, low long, high long, page_low long, page_high long"


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes of each batch, summed by host and path: for containers, and for possible notices with the least and largest hash of
    their texts and of their pages' texts."""
    for batch in batches:
        sums: dict[tuple[str, int, bool], list[int]] = {}

        def add(host: str, path: int, notice: bool, chars: int, text: int, page: int) -> None:
            s = sums.setdefault((host, path, notice), [0, 0, text, text, page, page])
            s[0] += 1
            s[1] += chars
            s[2:] = min(s[2], text), max(s[3], text), min(s[4], page), max(s[5], page)

        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = Page(html or "")
            if best := page.best():
                add(host, best[0], False, best[1], 0, 0)
            notices = dict(page.notices())
            whole = _text_hash([t for _, t, _ in page.blocks]) if notices else 0
            for path, text in notices.items():
                add(host, path, True, 0, text, whole)
        if sums:
            rows = [(*key, *s) for key, s in sums.items()]
            kinds = [pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in VOTES.split(", ")])


def host_paths(pages: DataFrame) -> DataFrame:
    """(_host, path, fixed): for each host the path with the most votes, then most text, then the larger hash; and the paths of notices,
    whose text is the same on all of at least REPEATS pages that are not all equal. Both are few: distinct generalised paths."""
    voted = map_arrow(pages.select("host", "html"), _vote, VOTES)
    ends = [F.min(c).alias(c) for c in ("low", "page_low")] + [F.max(c).alias(c) for c in ("high", "page_high")]
    summed = voted.groupBy("host", "path", "notice").agg(F.sum("votes").alias("votes"), F.sum("chars").alias("chars"), *ends)
    fixed = F.col("notice") & (F.col("low") == F.col("high")) & (F.col("page_low") < F.col("page_high")) & (F.col("votes") >= REPEATS)
    best = F.max_by("path", F.when(~F.col("notice"), F.struct("votes", "chars", "path")))
    return summed.groupBy(F.col("host").alias("_host")).agg(best.alias("path"), F.collect_set(F.when(fixed, F.col("path"))).alias("fixed"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row. Null html is empty; a null url is the host ''."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
        F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
    )
    paths = write_table(host_paths(rows), "host-paths")
    if (paths.agg(F.sum(F.octet_length("_host") + 8 * F.size("fixed") + 64)).first()[0] or 0) <= MOST_BYTES:
        paths = F.broadcast(paths)
    joined = rows.join(paths, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "path", "fixed")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, p, f) for h, p, f in zip(*(batch.column(c).to_pylist() for c in ("html", "path", "fixed")))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(joined, again, "page_id long, url string, text string, n_chars long")


def op4_html_text(pages: DataFrame) -> DataFrame:
    """The contract's columns for every page."""
    return extract_pages(pages)
