"""A tokeniser for HTML that takes time linear in the text, whatever the markup.

Tags follow HTML's own rules: a name begins with a letter right after '<' or '</'; an attribute's value is quoted only if
a quote comes right after its '='; a quote that is never closed belongs to an attribute's name; a tag that never ends
is text from its '<' on, tokenised anew. Comments are whole, as are script and style elements that are closed; what is
left open of those is a tag like any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Characters that a tag may take before the slow path decides about it.
WINDOW = 4096

_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_ATTRIBUTE = (r"(?:=[^\s/>=]*+|[^\s/>=]++)"                                   # a name; a leading '=' belongs to it
              r"(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?+)?+")  # and its value
_TAG = re.compile(rf"(?:[\s/]++|{_ATTRIBUTE})*+>")
_STEP = re.compile(rf"[\s/]*+(?:{_ATTRIBUTE})?+")
_VALUES = re.compile(r"(?:[\s/]++)|(=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+))?+)?+")
_DECLARATION = re.compile(r"<[!?/][^>]*>")
#: Elements whose content is no markup (fixed values).
RAW = {"script", "style"}


def attributes(tag: str) -> dict[str, str]:
    """Attributes of a tag's text, names in lower case, values as written; of equal names the first counts."""
    m = _NAME.match(tag)
    out: dict[str, str] = {}
    if m:
        for a in _VALUES.finditer(tag, m.end(), len(tag) - 1):
            if a[1]:
                out.setdefault(a[1].lower(), next((v for v in (a[2], a[3], a[4]) if v is not None), ""))
    return out


class Scanner:
    """Tokens (kind, name, text) of one document: 'text', 'open', 'close', 'comment', 'decl' and 'raw' (a whole script or
    style element)."""

    def __init__(self, text: str):
        self.text = text
        self.last_end = text.rfind(">")
        self.dead: set[int] = set()   # places inside a tag from which no end is reached
        self.closers: dict[str, re.Pattern] = {}
        self.gone: set[str] = set()   # what was searched for and doesn't occur any more

    def _tag_end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` ends, or -1. Every place is given up at most once."""
        if at > self.last_end:
            return -1
        if not self.dead:
            m = _TAG.match(self.text, at, at + WINDOW)
            if m:
                return m.end()
        passed = []
        while at not in self.dead:
            passed.append(at)
            at = _STEP.match(self.text, at).end()
            if at >= len(self.text):
                break
            if self.text[at] == ">":
                return at + 1
        self.dead.update(passed)
        return -1

    def _find(self, what: str, at: int) -> int:
        """Place of ``what`` from ``at`` on, or -1, which is remembered."""
        found = -1 if what in self.gone else self.text.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def _raw_end(self, name: str, at: int) -> int:
        """Where the closed script or style element whose tag ends at ``at`` ends, or -1."""
        if name in self.gone:
            return -1
        pattern = self.closers.setdefault(name, re.compile(rf"</{name}\s*+>", re.I))
        m = pattern.search(self.text, at)
        if not m:
            self.gone.add(name)
        return m.end() if m else -1

    def tokens(self) -> Iterator[tuple[str, str, str]]:
        text, at = self.text, 0
        while at < len(text):
            start = text.find("<", at)
            if start < 0:
                start = len(text)
            if start > at:
                yield "text", "", text[at:start]
                at = start
                continue
            end, kind, name = -1, "text", ""
            m = _NAME.match(text, at)
            if m:
                end = self._tag_end(m.end())
                if end >= 0:
                    kind, name = "close" if m[1] else "open", m[2].lower()
                    if name in RAW and kind == "open" and (whole := self._raw_end(name, end)) >= 0:
                        kind, end = "raw", whole
            elif text.startswith("<!--", at):
                found = self._find("-->", at + 4)
                if found >= 0:
                    kind, end = "comment", found + 3
            if end < 0 and not m and at < self.last_end and (m := _DECLARATION.match(text, at)):
                kind, end = "decl", m.end()
            if end < 0:
                end = at + 1
            yield kind, name, text[at:end]
            at = end
