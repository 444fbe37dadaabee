"""Sparse histograms: rows (chunk, word_idx, weight)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def count_words(rows: DataFrame, codebook: DataFrame, chunk_cols: list[str], on: str = "term") -> DataFrame:
    """(chunk..., word_idx, idf, tf) of rows (chunk..., term or word_idx); what the codebook lacks is dropped.

    The codebook has at most k rows and is broadcast.
    """
    known = F.broadcast(codebook.select(on, *(["word_idx"] if on != "word_idx" else []), "idf"))
    return rows.join(known, on).groupBy(*chunk_cols, "word_idx", "idf").agg(F.count(F.lit(1)).alias("tf"))


def log_weight(tf: Column, idf: Column) -> Column:
    """ln(1 + tf) * idf, where idf is a decimal logarithm."""
    return F.log1p(tf) * idf


def normalise(rows: DataFrame, chunk_cols: list[str], weight: str = "weight") -> DataFrame:
    """Weights divided by the chunk's norm; chunks whose norm is 0 keep their zeros."""
    length = F.sqrt(F.sum(F.col(weight) * F.col(weight)).over(W.partitionBy(*chunk_cols)))
    return rows.withColumn(weight, F.when(length > 0, F.col(weight) / length).otherwise(F.lit(0.0)))


def weighted_terms(counts: DataFrame, codebook: DataFrame, chunk_cols: list[str]) -> DataFrame:
    """(chunk..., word_idx, weight) of counted terms (chunk..., term, tf), not normalised, without zeros; nothing is shuffled."""
    known = F.broadcast(codebook.select("term", "word_idx", "idf"))  # at most k rows
    rows = counts.join(known, "term").select(*chunk_cols, "word_idx", log_weight(F.col("tf"), F.col("idf")).alias("weight"))
    return rows.where(F.col("weight") != 0)


def histograms(rows: DataFrame, codebook: DataFrame, chunk_cols: list[str], on: str = "term") -> DataFrame:
    """(chunk..., word_idx, weight): sublinear tf-idf of unit length, without zero weights."""
    counted = count_words(rows, codebook, chunk_cols, on)
    weighted = counted.select(*chunk_cols, "word_idx", log_weight(F.col("tf"), F.col("idf")).alias("weight"))
    return normalise(weighted, chunk_cols).where(F.col("weight") != 0)


def fuse_colour(shape: DataFrame, colour: DataFrame, k: int, alpha: float, chunk_cols: list[str]) -> DataFrame:
    """Shape histograms and colour bins as one: sqrt(1 - alpha) of the first, sqrt(alpha) of the second,
    whose words are shifted by ``k``.  ``alpha`` <= 0 leaves the shape alone."""
    if alpha <= 0:
        return shape
    first = shape.withColumn("weight", F.col("weight") * F.sqrt(F.lit(1 - alpha)))
    second = colour.withColumn("weight", F.col("weight") * F.sqrt(F.lit(alpha))).withColumn("word_idx", F.col("word_idx") + k)
    return first.unionByName(second.select(first.columns)).where(F.col("weight") != 0)


def sparse_of_dense(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id_col, word_idx, weight) of the entries that are neither 0 nor NaN."""
    rows = df.select(id_col, F.posexplode(vec_col).alias("word_idx", "weight"))
    return rows.where((F.col("weight") != 0) & ~F.isnan("weight")).withColumn("weight", F.col("weight").cast("double"))


def dense_of_sparse(rows: DataFrame, id_col: str, size: int) -> DataFrame:
    """(id_col, hist): arrays of ``size`` numbers."""

    @F.pandas_udf("array<double>")
    def scatter(words: pd.Series, weights: pd.Series) -> pd.Series:
        out = np.zeros((len(words), size))
        for i, (at, w) in enumerate(zip(words, weights)):
            out[i, at] = w
        return pd.Series(list(out))

    packed = rows.groupBy(id_col).agg(F.collect_list(F.struct("word_idx", "weight")).alias("m"))
    return packed.select(id_col, scatter(F.col("m.word_idx"), F.col("m.weight")).alias("hist"))


def of_chunk(postings: DataFrame, chunk_id, id_col: str = "chunk_id") -> DataFrame:
    """The histogram of one chunk, by a filter that reaches the scan."""
    return postings.where(F.col(id_col) == F.lit(chunk_id))
