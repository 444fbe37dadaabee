"""Codebooks: the most frequent terms of a corpus, or centroids of standardised descriptors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kelpline.functions.vectors import z_scored


@dataclass(frozen=True)
class CodebookSizes:
    """Numbers of words by use."""

    text: int = 1024
    text_build: int = 256
    text_class: int = 4096
    image: int = 256
    audio: int = 128
    sample: int = 500_000


class EmptyCodebook(RuntimeError):
    """There is nothing to quantise with."""


def count_terms(terms: DataFrame, chunk_col: str = "chunk_id") -> DataFrame:
    """(chunk, term, tf, pos) over rows (chunk, pos, term): how often and where first a chunk holds a term."""
    return terms.groupBy(chunk_col, "term").agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("pos"))


def term_statistics(terms: DataFrame, chunk_col: str = "chunk_id") -> DataFrame:
    """(term, freq, df, first_chunk, first_pos) over rows (chunk, pos, term) or counts of them: occurrences, chunks, first place."""
    per_chunk = terms if "tf" in terms.columns else count_terms(terms, chunk_col)
    return per_chunk.groupBy("term").agg(
        F.sum("tf").alias("freq"),
        F.count(F.lit(1)).alias("df"),
        F.min(F.struct(F.col(chunk_col).alias("chunk"), "pos")).alias("first"),
    ).select("term", "freq", "df", F.col("first.chunk").alias("first_chunk"), F.col("first.pos").alias("first_pos"))


def text_codebook(statistics: DataFrame, n_chunks: int, k: int) -> DataFrame:
    """(word_idx, term, freq, df, idf): the ``k`` most frequent terms, ties by first occurrence.

    idf is log10(chunks / df) over all chunks, those without terms included.
    """
    order = [F.desc("freq"), "first_chunk", "first_pos"]
    top = statistics.orderBy(*order).limit(k)  # bounded: the numbering below sees k rows
    place = (F.row_number().over(W.orderBy(*order)) - 1).cast("int")
    return top.select(
        place.alias("word_idx"), "term", "freq", "df", F.log10(F.lit(float(n_chunks)) / F.col("df")).alias("idf")
    )


def descriptor_sample(descriptors: DataFrame, key: list[str], size: int, seed: int = 0) -> DataFrame:
    """Exactly min(size, n) rows without replacement, always the same ones for a seed."""
    return descriptors.orderBy(F.xxhash64(*[F.col(c) for c in key], F.lit(seed)), *key).limit(size)


def z_fit(descriptors: DataFrame, vec_col: str = "vec") -> DataFrame:
    """(dim, mean, scale) per dimension; population deviation, 1 where it is 0."""
    rows = descriptors.select(F.posexplode(vec_col).alias("dim", "x"))
    spread = F.stddev_pop(F.col("x").cast("double"))
    return rows.groupBy("dim").agg(
        F.avg(F.col("x").cast("double")).alias("mean"), F.when(spread > 0, spread).otherwise(F.lit(1.0)).alias("scale")
    )


def z_apply(descriptors: DataFrame, scaler: DataFrame, vec_col: str = "vec") -> DataFrame:
    """Descriptors with every dimension centred and scaled; the scaler has one row per dimension."""
    rows = sorted((r["dim"], r["mean"], r["scale"]) for r in scaler.select("dim", "mean", "scale").collect())
    mean, scale = F.lit([float(m) for _, m, _ in rows]), F.lit([float(s) for _, _, s in rows])
    return descriptors.withColumn(vec_col, z_scored(F.col(vec_col), mean, scale))


def assign(descriptors: DataFrame, centroids: DataFrame, vec_col: str = "vec") -> DataFrame:
    """Descriptors with word_idx, the nearest centroid: argmax of x.c - |c|^2 / 2, ties to the lowest index.

    The centroids (bounded by the codebook's size) go to every task, where a block of descriptors is
    multiplied with all of them at once.
    """
    rows = sorted((r["word_idx"], list(r["vec"])) for r in centroids.select("word_idx", "vec").collect())
    if not rows:
        raise EmptyCodebook("the codebook has no centroid")
    words = np.array([w for w, _ in rows])
    c = np.array([v for _, v in rows], dtype=np.float64)
    half = (c * c).sum(1) / 2

    @F.pandas_udf("int")
    def nearest(vec: pd.Series) -> pd.Series:
        out = np.empty(len(vec), dtype=np.int32)
        for lo in range(0, len(vec), 4096):
            x = np.stack(vec.iloc[lo : lo + 4096].to_list()).astype(np.float64)
            # rounding keeps ties on the lowest index whatever the order of summation
            out[lo : lo + 4096] = words[np.round(x @ c.T - half, 9).argmax(1)]
        return pd.Series(out)

    return descriptors.withColumn("word_idx", nearest(F.col(vec_col)))


def lloyd(descriptors: DataFrame, initial: DataFrame, iterations: int, vec_col: str = "vec") -> DataFrame:
    """(word_idx, vec) after ``iterations`` rounds from given centroids; a centroid without members stays."""
    current = initial.select("word_idx", F.col("vec").cast("array<double>").alias("vec"))
    for _ in range(iterations):
        placed = assign(descriptors, current, vec_col).select("word_idx", F.posexplode(vec_col).alias("dim", "x"))
        means = placed.groupBy("word_idx", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
        packed = means.groupBy("word_idx").agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("v"))
        moved = packed.select("word_idx", F.col("v.m").alias("new"))
        # as many rows as the codebook has words
        current = current.join(moved, "word_idx", "left").select("word_idx", F.coalesce("new", "vec").alias("vec"))
        rows = [(r["word_idx"], list(r["vec"])) for r in current.collect()]
        current = descriptors.sparkSession.createDataFrame(rows, "word_idx int, vec array<double>")
    return current


def k_means(descriptors: DataFrame, k: int, seed: int = 0, vec_col: str = "vec", iterations: int = 20) -> DataFrame:
    """(word_idx, vec) by distributed k-means; min(k, number of descriptors) centroids."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = descriptors.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    n = rows.limit(k).count()
    if n == 0:
        raise ValueError("there is no descriptor")
    model = KMeans(k=min(k, n), seed=seed, initMode="k-means||", maxIter=iterations).fit(rows)
    found = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return descriptors.sparkSession.createDataFrame(found, "word_idx int, vec array<double>")


def visual_idf(assigned: DataFrame, centroids: DataFrame, item_col: str = "item_id") -> DataFrame:
    """(word_idx, df, idf) of every centroid: idf = log10(items with descriptors / max(df, 1))."""
    pairs = assigned.select(item_col, "word_idx").distinct()
    n = assigned.select(item_col).distinct().count()
    df = pairs.groupBy("word_idx").agg(F.count(F.lit(1)).alias("df"))
    every = centroids.select("word_idx").join(df, "word_idx", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    return every.withColumn("idf", F.log10(F.lit(float(max(n, 1))) / F.greatest("df", F.lit(1))))
