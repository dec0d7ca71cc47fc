"""Readable text out of HTML: one scanning pattern and a fold over its pieces, in Arrow batches."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements without readable text, and elements that end a line.
SILENT = {"script", "style", "head"}
BLOCKS = {"p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "section", "title"}

#: Comments, whole scripts and style sheets, tags (whose quoted values may hold any sign), declarations, and text.
PIECE = re.compile(
    r"""<!--.*?(?:-->|\Z)
    | <(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)
    | <(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?:"[^"]*"|'[^']*'|[^>"'])*(?:>|\Z)
    | <[!?/][^>]*(?:>|\Z)
    | (?P<text>[^<]+|<)""",
    re.S | re.I | re.X,
)


def text_of(html: str | None) -> str | None:
    """TX3, TX1: the text outside silent elements, a new line at each border of a block, blanks collapsed."""
    if html is None:
        return None
    depth, out = 0, []
    for piece in PIECE.finditer(html):
        name = (piece["name"] or "").lower()
        if name in SILENT:
            depth = max(0, depth + (-1 if piece["end"] else 1))
        if name in BLOCKS:
            out.append("\n")
        elif piece["text"] and not depth:
            out.append(unescape(piece["text"]))
    lines = re.sub(r"\r\n?", "\n", "".join(out))
    return re.sub(r"\n\s*\n+", "\n\n", re.sub(r"[ \t\f\v]+", " ", lines)).strip()


@F.pandas_udf(T.StringType())
def _html_text(html: pd.Series) -> pd.Series:
    return html.map(text_of, na_action="ignore")


def html_text(html: Column | str) -> Column:
    return _html_text(html)
