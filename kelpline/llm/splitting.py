"""Cutting oversized texts at natural boundaries.

Every position of a text at which it could be cut has a strength: after a stanza 4, after a line 3,
after a sentence 2, after a word 1.  A sparse table over these strengths answers the strongest cut of
any permissible length window in constant time; equal strengths are resolved to the right, which is
built into the key ``strength * (n + 1) + index``.  The next piece begins up to ``overlap`` characters
before the cut, at the first word start of that stretch; where there is none, all of the overlap.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import check_columns, latest_per_id

STANZA, LINE, SENTENCE, WORD, NONE = 4, 3, 2, 1, 0
_KIND = {STANZA: "stanza", LINE: "line", SENTENCE: "sentence", WORD: "word", NONE: "none"}
_GAP = re.compile(r"\s+")
_BLANK_LINE = re.compile("\\n[^\\S\\n]*\\n|\\r[^\\S\\r\\n]*\\r|\\u2029")
_LINE = re.compile("[\\n\\r\\v\\f\\x85\\u2028]")
_ENDS = frozenset(".!?…。！？।؟")
_CLOSES = frozenset("\"'”’»)]」』）")
_WIDE_END = re.compile(r"[。！？][”’」』）]*")


def _ends_sentence(text: str, end: int) -> bool:
    """An end mark stands before ``end``, with any number of closing marks behind it."""
    while end and text[end - 1] in _CLOSES:
        end -= 1
    return end > 0 and text[end - 1] in _ENDS


def cut_points(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions (ascending) after which a piece may end, with their strengths.

    A gap of white space belongs to the piece before it; cuts also follow the full stops of scripts
    that write no spaces.
    """
    strength: dict[int, int] = {}
    for m in _GAP.finditer(text):
        gap = m.group()
        if _BLANK_LINE.search(gap):
            s = STANZA
        elif _LINE.search(gap):
            s = LINE
        else:
            s = SENTENCE if _ends_sentence(text, m.start()) else WORD
        strength[m.end()] = s
    for m in _WIDE_END.finditer(text):
        strength.setdefault(m.end(), SENTENCE)
    at = np.fromiter(sorted(strength), dtype=np.int64, count=len(strength))
    return at, np.fromiter((strength[p] for p in at.tolist()), dtype=np.int64, count=len(at))


class RangeMax:
    """Sparse table: rightmost strongest entry of ``strengths[lo:hi]`` by two overlapping power-of-two spans."""

    def __init__(self, strengths: np.ndarray):
        n = len(strengths)
        key = strengths * (n + 1) + np.arange(n)
        self.n, self.levels = n, [key]
        span = 1
        while 2 * span <= n:
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-span], last[span:]))
            span *= 2

    def query(self, lo: int, hi: int) -> int | None:
        if lo >= hi:
            return None
        k = (hi - lo).bit_length() - 1
        row = self.levels[k]
        return int(max(row[lo], row[hi - (1 << k)]) % (self.n + 1))


def split_text(text: str, limit: int, overlap: int, shortest: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at end) of every piece."""
    n = len(text)
    if n == 0:
        return []
    if n <= limit:
        return [(0, n, "end")]
    at, strength = cut_points(text)
    table = RangeMax(strength)
    pieces, start = [], 0
    while n - start > limit:
        right = int(np.searchsorted(at, start + limit, side="right"))
        best = table.query(int(np.searchsorted(at, start + shortest)), right)
        if best is None:  # nothing natural in the window: any cut that still makes progress
            best = table.query(int(np.searchsorted(at, start + overlap + 1)), right)
        end, kind = (start + limit, NONE) if best is None else (int(at[best]), int(strength[best]))
        pieces.append((start, end, _KIND[kind]))
        # the first word start within the overlap; where there is none before the cut itself, step back by all of it
        k = int(np.searchsorted(at, end - overlap))
        back = int(at[k]) if k < len(at) and at[k] < end else end - overlap
        start = max(back, start + 1)
    pieces.append((start, n, "end"))
    return pieces


def split_oversized(
    df: DataFrame,
    id_col: str,
    text_col: str,
    limit: int = 1500,
    overlap: int = 100,
    shortest: int | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """Ordered pieces of at most ``limit`` characters, sharing up to ``overlap`` with the piece before.

    Result: ``id_col``, piece_pos (from 0), start_pos, end_pos, cut (kind of boundary at the end),
    piece.  Positions count code points.  A text within the limit is one piece with cut ``end``; a
    null or empty text has no piece; repeated ids count once (the greatest by ``order``, then text);
    null ids are left out.  Other columns of ``df`` are ignored, whatever their names.
    Texts within the limit never leave the JVM; only the oversized ones pass through Python.
    """
    check_columns(df, id_col, text_col)
    shortest = limit // 2 if shortest is None else shortest
    if not 0 <= overlap < shortest <= limit:
        raise ValueError("0 <= overlap < shortest <= limit must hold")
    rows = df.select(id_col, text_col, *[c for c in order or [] if c not in (id_col, text_col)])
    rows = rows.where(F.length(text_col) > 0)
    newest = latest_per_id(rows, id_col, [text_col], order, df.select(id_col))
    short, long = newest.where(F.length(text_col) <= limit), newest.where(F.length(text_col) > limit)

    whole = short.select(
        F.col(id_col),
        F.lit(0).alias("piece_pos"),
        F.lit(0).alias("start_pos"),
        F.length(text_col).alias("end_pos"),
        F.lit("end").alias("cut"),
        F.col(text_col).alias("piece"),
    )

    @F.pandas_udf("array<struct<start_pos:int,end_pos:int,cut:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: [{"start_pos": a, "end_pos": b, "cut": c} for a, b, c in split_text(t, limit, overlap, shortest)]
        )

    # not deterministic: else the filter that exploding infers would run it a second time
    cut = cut.asNondeterministic()
    parts = (
        long.withColumn("_cuts", cut(F.col(text_col)))
        .select(id_col, text_col, F.posexplode("_cuts").alias("piece_pos", "_cut"))
        .select(
            F.col(id_col),
            F.col("piece_pos"),
            F.col("_cut.start_pos").alias("start_pos"),
            F.col("_cut.end_pos").alias("end_pos"),
            F.col("_cut.cut").alias("cut"),
            F.expr(f"substring(`{text_col}`, _cut.start_pos + 1, _cut.end_pos - _cut.start_pos)").alias("piece"),
        )
    )
    return whole.unionByName(parts)
