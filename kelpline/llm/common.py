"""Small pieces that several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.runtime import materialize

#: Fixed value: the token class of the text pipeline, applied to lower-cased text.
TERM_PATTERN = "[a-záéíóúüñ0-9]+"


def repeated_ids(df: DataFrame, id_col: str) -> DataFrame:
    """The ids of more than one row, as a written table: a pass over the ids alone, whose size the planner then knows."""
    times = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    return materialize(times.where("_n > 1").select(id_col), "repeated")


def grouped_per_id(df: DataFrame, id_col: str, keep: list[str], order: list[str] | None = None) -> DataFrame:
    """The same as :func:`latest_per_id` by one aggregate over all rows: for what needs its rows spread by id anyway.

    It combines before the shuffle, so an id that holds a large share of all rows reaches its reducer as one row per input
    partition.
    """
    fields = list(dict.fromkeys(c for c in [*(order or []), *keep] if c in df.columns))
    ranked = F.max(F.struct(*[F.col(f"`{c}`") for c in fields])).alias("_row")
    rows = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(ranked)
    return rows.select(id_col, *[F.col(f"_row.`{c}`").alias(c) for c in keep])


def latest_per_id(df: DataFrame, id_col: str, keep: list[str], order: list[str] | None = None, ids: DataFrame | None = None) -> DataFrame:
    """One row per id with the columns ``keep``; of repeated ids the greatest (``order``, ``keep``) stays.

    Only the rows of repeated ids are shuffled; where these are few, the others pass as they are read.  Rows whose id is
    null are left out.  ``ids``, with the column ``id_col``, may stand for the ids of ``df`` and more: a table that
    can be read without what ``df`` needs for its filters.
    """
    repeated = repeated_ids(df if ids is None else ids, id_col)
    once = df.where(F.col(id_col).isNotNull()).join(repeated, id_col, "left_anti").select(id_col, *[F.col(f"`{c}`") for c in keep])
    return once.unionByName(grouped_per_id(df.join(repeated, id_col, "left_semi"), id_col, keep, order))


def terms_of(text: Column) -> Column:
    """Array of terms of a text; null text gives an empty array."""
    return F.coalesce(
        F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0)), F.array().cast("array<string>")
    )


def clean_term(term: Column) -> Column:
    """Codebook terms count lower-cased and without outer white space."""
    return F.regexp_replace(F.lower(term), r"(?U)^\s+|\s+$", "")


def check_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
