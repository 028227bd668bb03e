"""Spans of a stored text that match the query's words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def pattern(words: list[tuple[str, bool]]) -> re.Pattern | None:
    """Any of the (word, is prefix), longest first, at word borders and in either case."""
    ways = sorted(set(words), key=lambda w: (-len(w[0]), w))
    if not ways:
        return None
    return re.compile("(" + "|".join(rf"\b{re.escape(w)}" + (r"\w*" if p else r"\b") for w, p in ways) + ")", re.IGNORECASE)


def highlight(text: str, words: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """(text, is match) pieces that join to the text."""
    p = pattern(words)
    if p is None or not text:
        return [(text, False)]
    # an odd piece of a split by a group is a match
    return [(piece, i % 2 == 1) for i, piece in enumerate(p.split(text)) if piece]


def highlight_spans(text: Column, words: list[tuple[str, bool]]) -> Column:
    @F.pandas_udf("array<struct<text:string,is_match:boolean>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"text": a, "is_match": b} for a, b in highlight(t, words)])

    return run(text)


def marked(text: Column, words: list[str], left: str = "[", right: str = "]") -> Column:
    """The text with matches between marks, all in the JVM."""
    ways = "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))
    return F.regexp_replace(text, rf"(?i)\b({ways})\b", f"{left}$1{right}")
