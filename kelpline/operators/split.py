"""One item to many chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions.text import strip


def paragraphs(text: Column, min_chars: int = 1) -> Column:
    """Array of the parts between blank lines, stripped, of at least ``min_chars``; the whole stripped text
    if no part is long enough and it is not empty.  Null gives an empty array."""
    whole = strip(text)
    parts = F.filter(F.transform(F.split(whole, r"\n\s*\n+"), strip), lambda p: F.length(p) >= min_chars)
    kept = F.when(F.size(parts) > 0, parts).when(F.length(whole) > 0, F.array(whole))
    return F.coalesce(kept, F.array().cast("array<string>"))


def paragraph_chunks(items: DataFrame, id_col: str, text_col: str, min_chars: int = 1) -> DataFrame:
    """(id_col, position, content): the paragraphs of every item, numbered from 0 within it."""
    return items.select(id_col, F.posexplode(paragraphs(F.col(text_col), min_chars)).alias("position", "content"))

