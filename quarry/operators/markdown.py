"""HTML -> text.

Contract (ours; the reference delegates to a Markdown writer): no wrapping, emphasis / links / images dropped to
their text, one line break per block, headings as '#' x level, list items as '* ' or, in a numbered list, by their
numbers, rules as '* * *', quoted blocks with '> ' before each line, table cells separated by ' | ', every named and
numeric character reference decoded once, then the whitespace collapse of T2. A '<' that begins no tag is text.

One Arrow-batched pass per row over the tokens of a linear scanner; nothing is shuffled.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.markup import Scanner, attributes
from quarry.functions.text import py_strip

# What tags become.
BLOCKS = {"p", "div", "ul", "ol", "table", "tbody", "thead", "article", "section", "header", "footer", "nav", "main",
          "aside", "pre", "tr"}
HEADINGS = {f"h{n}": "#" * n for n in range(1, 7)}

COLLAPSE_RULES = [(r"[ \t]+", " "), (r"\n{3,}", "\n\n")]


def _quoted(text: str) -> str:
    lines = re.sub(r"\n{2,}", "\n", text.strip()).split("\n")
    return "\n\n" + "\n".join("> " + line.strip() for line in lines) + "\n\n"


def document_text(text: str) -> str:
    """T1 of one document, before the collapse of T2. A quote is a buffer of its own until it is closed; one that never
    is closed is a block like any other."""
    quotes: list[list[str]] = [[]]
    lists: list[int | None] = []  # the next number of each open list, None in a list without numbers
    for kind, name, token in Scanner(text).tokens():
        out = quotes[-1]
        if kind == "text":
            out.append(token)
        elif kind == "open":
            if name in BLOCKS or name == "br":
                out.append("\n")
            elif name in HEADINGS:
                out.append(f"\n\n{HEADINGS[name]} ")
            elif name == "li":
                if lists and lists[-1] is not None:
                    out.append(f"\n{lists[-1]}. ")
                    lists[-1] += 1
                else:
                    out.append("\n* ")
            elif name == "hr":
                out.append("\n\n* * *\n\n")
            elif name == "blockquote":
                quotes.append([])
            if name == "ol":
                start = attributes(token).get("start", "")
                lists.append(int(start) if start.isdecimal() else 1)
            elif name == "ul":
                lists.append(None)
        elif kind == "close":
            if name in BLOCKS or name == "li":
                out.append("\n")
            elif name in HEADINGS:
                out.append("\n\n")
            elif name in ("td", "th"):
                out.append(" | ")
            elif name == "blockquote":
                if len(quotes) > 1:
                    quotes.pop()
                    quotes[-1].append(_quoted("".join(out)))
                else:
                    out.append("\n")
            if name in ("ol", "ul") and lists:
                lists.pop()
    return html.unescape("\n".join("".join(q) for q in quotes)).replace("\xa0", " ")


def html_to_text(col) -> Column:
    """T1 + T2 on a column; null stays null."""
    c = F.col(col) if isinstance(col, str) else col

    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else document_text(x))
    return collapse_whitespace(F.pandas_udf(convert, "string")(c))


def collapse_whitespace(col) -> Column:
    """Runs of spaces/tabs -> one space, 3+ newlines -> 2, then Python-style strip."""
    c = F.col(col) if isinstance(col, str) else col
    for pattern, repl in COLLAPSE_RULES:
        c = F.regexp_replace(c, pattern, repl)
    return py_strip(c)


def convert_dataframe(df: DataFrame, column: str = "body", output_column: str = "body") -> DataFrame:
    """Write the text of ``column`` to ``output_column``."""
    return df.withColumn(output_column, html_to_text(column))
