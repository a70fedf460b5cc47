"""Operator 9: main text of web pages by markup regions and nearest-URL page differencing.

A page becomes a list of text blocks, each with the region it stands in. Blocks of scripts, menus, forms, adverts,
notices, comments and the like (by element, role or class) go. Where a page marks its article, the article's
blocks are its text. Elsewhere nothing tells template from text, and there the page is differenced: the distinct block lists of a
host are put in the order of their URL paths, a page's block list is aligned with that of its nearest
neighbour by longest common subsequence, and the shared blocks go.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.markup import Scanner, attributes
from quarry.llm.common import bounded_batches, columns, materialize, ordered_totals, read, string_column

# Elements of HTML by what they mean here.
#: Their content is never text.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "object", "head", "title", "textarea"}
#: Their text belongs to the page, not to the article.
CHROME = {"nav", "aside", "footer", "form", "menu", "dialog", "button", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: They stand inside a line of text; all other elements begin and end a block.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
          "ins", "kbd", "label", "mark", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub",
          "sup", "time", "tt", "u", "var", "wbr"}
#: Words of a class or id that mark what doesn't belong to the article.
MARKS = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "consent", "cookie",
         "cookies", "disqus", "footer", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
         "notice", "pager", "pagination", "popup", "promo", "related", "share", "sidebar", "signup", "social", "sponsor",
         "sponsored", "subscribe", "toolbar", "widget"}
COMMENTS = {"comment", "comments", "respond", "replies"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}
_WHOLE = {"html", "body", "main", "article"}
#: Elements that end an open paragraph; elements that end an open one of the same kind, with what bounds the search for it; elements
#: that most closes don't reach out of; elements whose close reaches out of those.
PARAGRAPH_ENDS = {"address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
                  "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main",
                  "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"}
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
           "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
           "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "body": ({"head"}, {"html"})}
SCOPES = {"table", "td", "th", "caption", "button"}
REACHING = {"html", "body", "main", "article", "section", "nav", "aside", "header", "footer", "form", "table", "tbody", "thead", "tfoot",
            "tr", "td", "th", "caption", "button"}


def _mark(tag: str, token: str, inside: bool) -> str:
    """'' for text, 'chrome' or 'comments' by the element's attributes. Inside an article or main part only whole classes
    count: there an id is made from a heading, and 'no-sidebar' says nothing of the kind. But an element that is no heading and
    whose whole id says comments holds them."""
    found = attributes(token)
    if not found:
        return ""
    classes = html.unescape(found.get("class", "")).lower()
    words = set(classes.split() if inside else re.split(r"[^a-z]+", f"{classes} {html.unescape(found.get('id', '')).lower()}"))
    if inside and not re.fullmatch("h[1-6]", tag):
        words |= {html.unescape(found.get("id", "")).strip().lower()} & COMMENTS
    if words & COMMENTS and tag not in ("html", "body", "main"):
        return "comments"
    if tag in _WHOLE:
        return ""
    style = html.unescape(found.get("style", "")).replace(" ", "").lower()
    if (words & MARKS or found.get("role", "").lower() in ROLES or "hidden" in found
            or found.get("aria-hidden", "").lower() == "true" or "display:none" in style):
        return "chrome"
    return ""


class _Open:
    """The stack of open elements: (name, why it is left out or '', whether it has a close of its own)."""

    def __init__(self):
        self.stack: list[tuple[str, str, bool]] = []
        self.left_out = self.ended = self.comments = self.article = self.main = 0
        self.names: dict[str, int] = {}
        self.marks: list[int] = []  # places of the elements that are left out

    def _count(self, entry: tuple[str, str, bool], by: int) -> None:
        name, why, closed = entry
        self.names[name] = self.names.get(name, 0) + by
        self.left_out += by if why else 0
        self.ended += by if why and closed else 0
        self.comments += by if why == "comments" else 0
        self.article += by if name == "article" else 0
        self.main += by if name == "main" else 0

    def push(self, name: str, why: str, closed: bool) -> None:
        if why:
            self.marks.append(len(self.stack))
        self.stack.append((name, why, closed))
        self._count(self.stack[-1], 1)

    def cut(self, at: int) -> None:
        for entry in self.stack[at:]:
            self._count(entry, -1)
        del self.stack[at:]
        while self.marks and self.marks[-1] >= at:
            self.marks.pop()

    def close(self, names: set[str], bounds: set[str]) -> None:
        """End the nearest open element of these names, and what is open inside it, unless a bound comes first."""
        if not any(self.names.get(name) for name in names):
            return
        for at in range(len(self.stack) - 1, -1, -1):
            name = self.stack[at][0]
            if name in names:
                self.cut(at)
                return
            if name in bounds:
                return

    def resume(self) -> None:
        """An article is never part of a menu that is left open: end the outermost such element."""
        if self.left_out and not self.ended:
            self.cut(self.marks[0])


def _closed(tokens: list[tuple[str, str, str]]) -> set[int]:
    """Places of the opens that have a close of their own."""
    opened: dict[str, list[int]] = {}
    out = set()
    for i, (kind, name, _) in enumerate(tokens):
        if kind == "open":
            opened.setdefault(name, []).append(i)
        elif kind == "close" and opened.get(name):
            out.add(opened[name].pop())
    return out


def blocks(page: str) -> list[tuple[str, str]]:
    """(region, text) of every block that may be text: 'article', 'main' or 'body', in page order.

    Elements end as HTML says: by their close, by that of an element around them, or by an element that implies their end (a
    paragraph by the next block, an item by the next item, a cell by the next cell), so leaving one out never takes more than it
    holds."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    tokens = list(Scanner(page).tokens())
    closed = _closed(tokens)
    opened = _Open()

    def flush():
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(("article" if opened.article else "main" if opened.main else "body", text))
            parts.clear()

    for i, (kind, tag, token) in enumerate(tokens):
        if kind == "text":
            if not opened.left_out:
                parts.append(html.unescape(token))
            continue
        if kind not in ("open", "close"):
            continue
        if tag not in INLINE and not opened.left_out:
            flush()
        if kind == "close":
            opened.close({tag}, SCOPES - {tag} if tag not in REACHING else set())
            continue
        if tag in PARAGRAPH_ENDS:
            opened.close({"p"}, SCOPES)
        if tag in IMPLIED:
            opened.close(*IMPLIED[tag])
        if tag in VOID:
            if not opened.left_out:
                parts.append(" ")
            continue
        if tag in RAW:
            if i in closed:  # one that is left open hides nothing
                opened.push(tag, "chrome", True)
            continue
        inside = bool(opened.article or opened.main)
        why = "chrome" if tag in CHROME or (tag == "header" and not inside) else _mark(tag, token, inside)
        if tag in ("article", "main") and why != "comments" and opened.left_out and not opened.comments:
            opened.resume()
        if not token.endswith("/>"):
            if why and not opened.left_out:
                flush()
            opened.push(tag, why, i in closed)
    if not opened.left_out:
        flush()
    return out


def marked_text(found: list[tuple[str, str]]) -> str | None:
    """The text of a page that marks its article or main part: the articles, or the whole main part where more of its
    text is outside them; None for a page that marks neither."""
    article = [t for r, t in found if r == "article"]
    main = [t for r, t in found if r == "main"]
    if not article and not main:
        return None if found else ""
    if sum(map(len, article)) >= sum(map(len, main)):
        return "\n".join(article)
    return "\n".join(t for r, t in found if r != "body")


def common_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in ``a`` of a longest common subsequence with ``b``, in memory linear in their lengths."""
    if not len(a) or not len(b):
        return np.zeros(0, dtype=np.int64)
    head = 0
    limit = min(len(a), len(b))
    same = a[:limit] == b[:limit]
    head = limit if same.all() else int(np.argmin(same))
    rest = limit - head
    same = a[len(a) - rest:][::-1] == b[len(b) - rest:][::-1]
    tail = rest if same.all() else int(np.argmin(same)) if rest else 0
    mid_a, mid_b = a[head:len(a) - tail], b[head:len(b) - tail]
    ends = [np.arange(head), np.arange(len(a) - tail, len(a))]
    mid_a_at = head + np.flatnonzero(np.isin(mid_a, mid_b))
    mid_a, mid_b = a[mid_a_at], mid_b[np.isin(mid_b, mid_a)]
    if not len(mid_a):
        inner = mid_a_at
    elif len(mid_a) == 1:
        inner = mid_a_at[:1]
    else:
        def lengths(x, y):
            row = np.zeros(len(y) + 1, dtype=np.int64)
            for v in x:
                row[1:] = np.maximum(row[1:], row[:-1] + (y == v))
                row = np.maximum.accumulate(row)
            return row
        cut = len(mid_a) // 2
        total = lengths(mid_a[:cut], mid_b) + lengths(mid_a[cut:][::-1], mid_b[::-1])[::-1]
        split = int(total.argmax())
        inner = np.concatenate([mid_a_at[common_lines(mid_a[:cut], mid_b[:split])],
                                mid_a_at[cut + common_lines(mid_a[cut:], mid_b[split:])]])
    return np.concatenate([ends[0], inner, ends[1]]).astype(np.int64)


def _place(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path
    except ValueError:
        return "", url or ""


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2 ** 63


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Pages that mark an article (or else a main part) are finished by the scan. The other pages' blocks, and of all
    pages the hashes of the blocks outside an article, are grouped into a host's distinct block lists, so that a copy is
    never a neighbour; each list stands at its first path. They are ordered by host and path (a range partitioning, so
    one host may hold any share of the pages), and each meets its two neighbours by an equi-join on its place
    in that order; the one with the longer common start of the path is its partner, the earlier one in a tie. A list
    that its partner holds as a whole is differenced against the other neighbour, and kept if that holds it too.

    Defined cases: null and empty html give an empty text; a null or malformed URL is a page of the nameless host;
    pages that repeat an id or a URL are pages of their own, in the order of their ids; a host's only page shares nothing; an empty
    table gives no rows.
    """
    bounded_batches(pages.sparkSession)
    src = columns(pages, id_col, url_col, html_col).select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page in string_column(batch, "html"):
                texts.append(marked_text(blocks(page)))
            keep = pa.array([t is not None for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"]).filter(keep)

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, page in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(),
                                          string_column(batch, "html")):
                found = blocks(page)
                loose = [t for r, t in found if r == "body"]
                open_page = bool(found) and len(loose) == len(found)
                if loose:
                    hashes = [_hash(t) for t in loose]
                    key = hashlib.blake2b(np.array(hashes, dtype=np.int64).tobytes(), digest_size=16).digest()
                    rows.append((page_id, url, *_place(url), key, hashes, loose if open_page else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)],
                                             names=["page_id", "url", "host", "path", "key", "hashes", "lines"])

    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string())]
    done = src.mapInArrow(extract, "page_id long, url string, text string")
    outlined = materialize(src.mapInArrow(outline, "page_id long, url string, host string, path string, key binary, "
                                                   "hashes array<long>, lines array<string>"), "op9-outlines")
    distinct = outlined.groupBy("host", "key").agg(F.min(F.struct("path", "page_id")).alias("_first"), F.first("hashes").alias("hashes"),
                                                   F.first("lines", ignorenulls=True).alias("lines"))
    distinct = distinct.select("host", "key", F.col("_first.path").alias("path"), F.col("_first.page_id").alias("page_id"), "hashes", "lines")
    placed = ordered_totals(distinct, ["path", "page_id", "key"], [], group=["host"], name="op9-distinct")

    def neighbour(step: int, tag: str) -> DataFrame:
        return placed.select(F.col("host").alias(f"_h{tag}"), (F.col("_row") + step).alias(f"_r{tag}"),
                             F.col("path").alias(f"path_{tag}"), F.col("hashes").alias(f"hashes_{tag}"))

    both = placed.filter("lines is not null")
    for step, tag in ((1, "before"), (-1, "after")):
        both = both.join(neighbour(step, tag), (F.col("host") == F.col(f"_h{tag}")) & (F.col("_row") == F.col(f"_r{tag}")), "left")

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def alike(a: str, b: str | None) -> int:
            return -1 if b is None else next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

        for batch in batches:
            texts = []
            for p in batch.to_pylist():
                before, after = alike(p["path"], p["path_before"]), alike(p["path"], p["path_after"])
                both = [p["hashes_before"], p["hashes_after"]]
                gone: set = set()
                for partner in both if before >= after else both[::-1]:
                    shared = common_lines(np.array(p["hashes"], dtype=np.int64), np.array(partner or [], dtype=np.int64))
                    if partner and len(shared) < len(p["hashes"]):
                        gone = set(shared.tolist())
                        break
                texts.append("\n".join(t for k, t in enumerate(p["lines"]) if k not in gone))
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("key"), pa.array(texts, pa.string())],
                                             names=["_host", "_key", "text"])

    opened = both.select("host", "key", "path", "hashes", "lines", "path_before", "hashes_before", "path_after", "hashes_after")
    opened = opened.mapInArrow(difference, "_host string, _key binary, text string")
    opened = (outlined.filter("lines is not null").select("page_id", "url", "host", "key")
              .join(opened, (F.col("host") == F.col("_host")) & (F.col("key") == F.col("_key"))).select("page_id", "url", "text"))
    return done.union(opened).withColumn("n_chars", F.length("text").cast("long"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))
