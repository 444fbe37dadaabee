"""From a parsed query to a DataFrame over the indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.functions.text import query_frame
from kelpline.operators import search
from kelpline.operators.index import Index
from kelpline.plans.language import Query, parse


class IndexNotBuilt(LookupError):
    """There is no index for the collection of the query."""


class NotFound(LookupError):
    """There is no item of the name that the query gives."""


def project(df: DataFrame, fields: tuple[str, ...] | None) -> DataFrame:
    """The wanted columns in the frame's order; score always stays, unknown names are ignored."""
    if fields is None:
        return df
    return df.select([c for c in df.columns if c in fields or c == "score"])


def plan(query: Query, indexes: dict[str, Index], over_fetch: int | None = 5) -> DataFrame:
    """Text is compared by terms; audio and image by the stored histogram of the named file."""
    index = indexes.get(query.modality)
    if index is None:
        raise IndexNotBuilt(f"there is no {query.modality} index")
    if query.modality == "text":
        found = search.search_text_items(index, query_frame(index.postings.sparkSession, query.value), query.limit, over_fetch)
    else:
        if index.items.where(F.col("filename") == query.value).isEmpty():
            raise NotFound(f"there is no {query.modality} item {query.value!r}")
        found = search.search_like(index, "filename", query.value, query.limit)
    return project(found.drop("query_id").orderBy("place"), query.fields)


def run(text: str, indexes: dict[str, Index], over_fetch: int | None = 5) -> DataFrame:
    return plan(parse(text), indexes, over_fetch)
