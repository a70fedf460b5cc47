"""Scalar text and id-list expressions (P1-P5 and the strip used by T2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the instruction put in front of queries, bodies and rewritten queries before encoding.
QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "
# Fixed value: characters of the article body passed to the title generator.
HEAD_SIZE = 1500

# Python's str.split()/strip() whitespace, spelled out (Java's and RE2's \s differ from it and from each other).
WS_CLASS = (r"[\t\n\x{000B}\f\r \x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
_WS = WS_CLASS
# The same characters as a literal set, for btrim.
WS_CHARS = ("\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_prefix(col, prefix: str = QUERY_INSTRUCTION) -> Column:
    """Instruction prefix (queries, bodies, rewritten queries; never titles)."""
    return F.concat(F.lit(prefix), _col(col))


def text_head(col, n: int = HEAD_SIZE) -> Column:
    """First n characters (code points, as Python slicing counts them)."""
    return F.substring(_col(col), 1, n)


def py_strip(col) -> Column:
    """Python ``str.strip()``: leading and trailing Unicode whitespace, U+00A0 included."""
    return F.btrim(_col(col), F.lit(WS_CHARS))


def split_ws(col) -> Column:
    """Python ``str.split()``: split on runs of Unicode whitespace, no empty tokens."""
    return F.filter(F.split(_col(col), _WS + "+"), lambda t: t != "")


def parse_gt(col) -> Column:
    """Strict ground-truth parse. Whitespace-separated ids -> distinct BIGINT array; null -> []. A token that
    is no integer is an error: left out, it would shrink the ground truth and raise the score."""
    def number(t):
        bad = F.raise_error(F.concat(F.lit("not an article id in a ground truth: "), t)).cast("bigint")
        return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint")).otherwise(bad)
    ids = F.transform(split_ws(col), number)
    return F.coalesce(F.array_distinct(ids), F.array().cast("array<bigint>"))


def parse_gt_lenient(col) -> Column:
    """Lenient parse. Keep digit-only tokens, keep repeats, in order; null -> []."""
    ids = F.transform(F.filter(split_ws(col), lambda t: t.rlike("^[0-9]+$")), lambda t: t.cast("bigint"))
    return F.coalesce(ids, F.array().cast("array<bigint>"))


def char_length(col) -> Column:
    """P5: length in characters (code points); null counts as 0."""
    return F.coalesce(F.length(_col(col)), F.lit(0)).cast("bigint")
