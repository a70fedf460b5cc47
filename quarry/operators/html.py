"""HTML article cleanup (H1-H14): one row in, one row out, no shuffle.

A document is cut into tags and text by a linear scanner (quarry.functions.markup) and cleaned in one Arrow-batched pass.
Flat steps (images, breaks, inputs, headline/chunk) are decided tag by tag; element steps are sweeps over the tokens.
Documents are independent, so nothing is exchanged, sorted or joined back, and rows that share an id, or have none,
stay rows of their own.

Elements are those of the reference's parser: a close ends the nearest open element of its name and, with it, every
element inside that is still open; an element that nothing ends reaches to the end of the document; a stray close is no
element. So an unclosed <p> in a <div> ends with the <div>.

Step order follows the reference and is part of the contract: images, breaks, inputs, empty labels, links,
headline/chunk, empty p/div/span/strong/em, factoids, spoilers, tabsets, nested tables, empty tables, then the
children of <body>. H6 runs with the flat steps: unwrapping tags changes no text and no other step looks at those
two tags.

Spoilers are taken outermost first and in document order, so one inside another's content is treated in its turn.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.markup import Scanner, attributes
from quarry.functions.text import WS_CHARS

# Tag sets of the cleanup steps.
EMPTY_TAGS = ["p", "div", "span", "strong", "em"]
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
             "track", "wbr"]

# Class tokens the steps look at, as bits of the per-tag class mask.
CLASS_BITS = {"factoid": 1, "spoiler": 2, "spoiler-content": 4, "spoiler-text": 8, "tabset": 16, "tab-panel": 32,
              "tab-label": 64}

STEPS = ["images", "breaks", "inputs", "empty_labels", "links", "headline_chunk", "empty_tags", "factoids",
         "spoilers", "tabsets", "nested_tables", "empty_tables", "body"]


def _alternative(tag: str) -> str:
    """The text that stands for an image: its alternative text, stripped."""
    alt = attributes(tag).get("alt", "").strip(WS_CHARS)
    return alt.replace("<", "&lt;").replace(">", "&gt;")


class Tokens:
    """A document's tokens. A step removes tokens or replaces one by a heading; positions never move.

    An open token ``i`` has ``close[i]``, the position of its own close tag (-1 without one), and ``stop[i]``, the position
    after its last token."""

    def __init__(self, text: str, steps=()):
        self.tok, self.kind, self.name, self.cls = [], [], [], []
        for kind, name, tok in Scanner(text).tokens():
            if kind in ("comment", "raw") or (name in ("headline", "chunk") and "headline_chunk" in steps):
                continue
            if kind == "open":
                if name == "img" and "images" in steps:
                    kind, name, tok = "text", "", _alternative(tok)
                elif name == "br" and "breaks" in steps:
                    kind, name, tok = "text", "", " "
                elif name == "input" and "inputs" in steps:
                    continue
                elif name in VOID_TAGS or tok.endswith("/>"):
                    kind = "void"
                if not tok:
                    continue
            self.tok.append(tok)
            self.kind.append(kind)
            self.name.append(name)
        n = len(self.tok)
        self.cls, self.alive = [0] * n, [True] * n
        self.close, self.stop = [-1] * n, [-1] * n
        self.heading: dict[int, str] = {}
        opened: list[int] = []
        count: dict[str, int] = {}
        for i, (kind, name) in enumerate(zip(self.kind, self.name)):
            if kind == "open":
                opened.append(i)
                count[name] = count.get(name, 0) + 1
                if "class" in self.tok[i].lower():
                    words = set(attributes(self.tok[i]).get("class", "").split())
                    self.cls[i] = sum(bit for c, bit in CLASS_BITS.items() if c in words)
            elif kind == "close" and count.get(name):
                while True:
                    j = opened.pop()
                    count[self.name[j]] -= 1
                    self.stop[j] = i
                    if self.name[j] == name:
                        self.close[j], self.stop[j] = i, i + 1
                        break
        for j in opened:
            self.stop[j] = n

    def opens(self, name: str | None = None, cls: str | None = None, inside: tuple[int, int] | None = None) -> list[int]:
        """Opens of living elements, in document order."""
        bit = CLASS_BITS[cls] if cls else 0
        lo, hi = inside or (-1, len(self.tok))
        return [i for i in range(lo + 1, hi) if self.kind[i] == "open" and self.alive[i]
                and (name is None or self.name[i] == name) and (not bit or self.cls[i] & bit)]

    def end(self, i: int) -> int:
        """Where the content of element ``i`` ends."""
        return self.close[i] if self.close[i] >= 0 else self.stop[i]

    def unwrap(self, i: int) -> None:
        self.alive[i] = False
        if self.close[i] >= 0:
            self.alive[self.close[i]] = False

    def pieces(self, lo: int, hi: int) -> list[str]:
        """Stripped pieces of text between two positions, those without text left out."""
        out = []
        for i in range(lo + 1, hi):
            if self.alive[i]:
                if i in self.heading:
                    out += [self.heading[i], ":"]
                elif self.kind[i] == "text":
                    out.append(self.tok[i].strip(WS_CHARS))
        return [p for p in out if p]

    def blank(self, i: int) -> bool:
        return i not in self.heading and (self.kind[i] != "text" or not html.unescape(self.tok[i]).strip(WS_CHARS))

    def drop(self, lo: int, hi: int) -> None:
        self.alive[lo:hi] = [False] * (hi - lo)

    def head(self, i: int, title: str) -> None:
        """Put a heading in the place of token ``i``."""
        self.tok[i] = f"<p><strong>{title}</strong>: </p>"
        self.kind[i], self.alive[i], self.heading[i] = "html", True, title

    def text(self) -> str:
        return "".join(t for t, a in zip(self.tok, self.alive) if a)


def remove_empty(t: Tokens, tags: list[str]) -> None:
    """Remove elements of the given tags whose text is blank, all entities decoded."""
    seen, filled = [0] * (len(t.tok) + 1), 0
    for i in range(len(t.tok)):
        filled += t.alive[i] and not t.blank(i)
        seen[i + 1] = filled
    for i in t.opens():
        if t.alive[i] and t.name[i] in tags and seen[t.stop[i]] == seen[i]:
            t.drop(i, t.stop[i])


def unwrap_links(t: Tokens) -> None:
    """H5: an <a> becomes its text: every tag inside the link goes, with the link's own tags."""
    for i in t.opens("a"):
        if t.alive[i]:
            for j in range(i, t.stop[i]):
                if t.kind[j] not in ("text", "html"):
                    t.alive[j] = False


def unwrap_factoids(t: Tokens) -> None:
    """H8: drop the tags of divs whose class list holds the token 'factoid'; the content stays."""
    for i in t.opens("div", "factoid"):
        t.unwrap(i)


def clean_spoilers(t: Tokens) -> None:
    """H9: a div.spoiler is replaced by the children of its first .spoiler-content, led by
    <p><strong>title</strong>: </p> when its first .spoiler-text has text; without content or children the whole
    spoiler goes. A spoiler that is left in another's content follows in its turn."""
    for i in t.opens("div", "spoiler"):
        if not t.alive[i]:
            continue
        stop = t.stop[i]
        content = next(iter(t.opens(cls="spoiler-content", inside=(i, stop))), None)
        titled = next(iter(t.opens(cls="spoiler-text", inside=(i, stop))), None)
        title = "".join(t.pieces(titled, t.end(titled))) if titled is not None else ""
        if content is None or not any(t.alive[content + 1:t.end(content)]):
            t.drop(i, stop)
            continue
        t.drop(t.end(content), stop)
        t.drop(i, content + 1)
        if title:
            t.head(content, title)


def clean_tabsets(t: Tokens) -> Tokens:
    """The children of every div.tab-panel, led by the heading of the label.tab-label with the same number (none for
    surplus panels and for panels without children), take the place of their tabset; the rest of the tabset goes. A
    tabset without panels is unwrapped.

    Panels and labels are all those inside the tabset, at any depth, in document order, as the reference counts them:
    the children of a panel inside a panel come after those of the outer one, and a tabset inside a tabset, whose panels
    are emptied by that, goes."""
    moved = False
    for i in t.opens("div", "tabset"):
        if not t.alive[i]:
            continue
        stop = t.stop[i]
        titles = ["".join(t.pieces(j, t.end(j))) for j in t.opens("label", "tab-label", (i, stop))]
        panels = t.opens("div", "tab-panel", (i, stop))
        if not panels:
            t.unwrap(i)
            continue
        parts = []
        for k, j in enumerate(panels):
            filled = any(t.alive[j + 1:t.end(j)])
            parts.append((titles[k] if filled and k < len(titles) else "", _own_children(t, j, panels)))
        nested = any(b < t.stop[a] for a, b in zip(panels, panels[1:])) or len(t.opens("div", "tabset", (i, stop))) > 0
        if nested:
            text = "".join((f"<p><strong>{title}</strong>: </p>" if title else "") + "".join(t.tok[p] for p in places)
                           for title, places in parts)
            t.drop(i, stop)
            t.tok[i], t.kind[i], t.alive[i], moved = text, "html", True, True
            continue
        kept = {p for _, places in parts for p in places}
        for p in range(i, stop):
            t.alive[p] = p in kept
        for (title, _), j in zip(parts, panels):
            if title:
                t.head(j, title)
    return Tokens(t.text()) if moved else t


def _own_children(t: Tokens, panel: int, panels: list[int]) -> list[int]:
    """Living tokens inside a panel, less the children of panels inside it and less tabsets that have panels; other
    tabsets are unwrapped."""
    out, p, end = [], panel + 1, t.end(panel)
    loose: set[int] = set()
    while p < end:
        if t.alive[p]:
            if t.kind[p] == "open" and t.name[p] == "div":
                if t.cls[p] & CLASS_BITS["tabset"]:
                    if any(p < q < t.stop[p] for q in panels):
                        p = t.stop[p]
                        continue
                    loose |= {p, t.close[p]}
                if t.cls[p] & CLASS_BITS["tab-panel"]:
                    out.append(p)
                    p = t.end(p)
                    continue
            if p not in loose:
                out.append(p)
        p += 1
    return out


def flatten_nested_tables(t: Tokens) -> None:
    """A table inside a table becomes its text: the stripped, non-blank text pieces joined by a space."""
    outer = 0   # where the outermost table around ends
    done = 0    # where the last flattened table ends
    for i in t.opens("table"):
        if i >= outer:
            outer = t.stop[i]
        elif i >= done:
            pieces = [p for p in t.pieces(i, t.end(i)) if html.unescape(p).strip(WS_CHARS)]
            t.drop(i, t.stop[i])
            if pieces:
                t.tok[i], t.kind[i], t.alive[i] = " ".join(pieces), "text", True
            done = t.stop[i]


def body_children(t: Tokens) -> None:
    """The tokens inside the first <body>, or the whole document when there is none."""
    start = next(iter(t.opens("body")), None)
    if start is not None:
        t.drop(t.end(start), len(t.tok))
        t.drop(0, start + 1)


ELEMENT_STEPS = {
    "empty_labels": lambda t: remove_empty(t, ["label"]),
    "links": unwrap_links,
    "empty_tags": lambda t: remove_empty(t, EMPTY_TAGS),
    "factoids": unwrap_factoids,
    "spoilers": clean_spoilers,
    "tabsets": clean_tabsets,
    "nested_tables": flatten_nested_tables,
    "empty_tables": lambda t: remove_empty(t, ["table"]),
    "body": body_children,
}


def clean_document(text: str, steps) -> str:
    t = Tokens(text, steps)
    for step in steps:
        if step in ELEMENT_STEPS:
            t = ELEMENT_STEPS[step](t) or t
    return t.text()


def clean_html(df: DataFrame, column: str = "body", id_col: str = "article_id", steps=None) -> DataFrame:
    """``df`` with ``column`` cleaned; ``steps`` (names from STEPS) selects a subset, in order.

    A null stays null. ``id_col`` is not looked at.
    """
    steps = STEPS if steps is None else [s for s in STEPS if s in steps]

    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else clean_document(x, steps))

    return df.withColumn(column, F.pandas_udf(clean, "string")(F.col(column)))
