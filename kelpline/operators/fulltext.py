"""Boolean full text: chunks that hold every term of a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kelpline.functions.text import Analyzer


def term_postings(chunks: DataFrame, text_col: str, analyzer: Analyzer, *keep: str) -> DataFrame:
    """(keep..., term, tf): the full-text index; null texts have no terms."""
    return analyzer.exploded(chunks, text_col, *keep).groupBy(*keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def match_all(postings: DataFrame, queries: DataFrame, analyzer: Analyzer, text_col: str = "text", id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id_col, rank) of the chunks that hold all terms of a query; a query without terms matches nothing.

    rank is the sum of ln(1 + tf) over the terms divided by their number.
    """
    asked = analyzer.exploded(queries, text_col, "query_id").select("query_id", "term").distinct()
    wanted = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    hits = postings.join(asked, "term").groupBy("query_id", id_col).agg(
        F.count(F.lit(1)).alias("_have"), F.sum(F.log1p("tf")).alias("_sum")
    )
    return hits.join(wanted, "query_id").where("_have = _n").select("query_id", id_col, (F.col("_sum") / F.col("_n")).alias("rank"))


def best_items(matches: DataFrame, chunks: DataFrame, n: int, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, item_id, rank, place): the highest rank of each item's chunks."""
    top = matches.join(chunks.select(id_col, "item_id"), id_col).groupBy("query_id", "item_id").agg(F.max("rank").alias("rank"))
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("rank", 6)), "item_id")
    return top.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
