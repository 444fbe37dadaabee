"""Inverted indexes: blocks of chunks with their weights, postings (word_idx, chunk_id, weight), norms (chunk_id, norm).

A block is one row with all weights of a few thousand chunks whose ids follow each other, so what a chunk
scores is known within one task.  Postings are the same numbers as rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.functions.text import Analyzer
from kelpline.operators import codebook as cb
from kelpline.operators import histogram as hg
from kelpline.operators.split import paragraph_chunks
from kelpline.runtime import materialize, range_partitions
from kelpline.sources.songs import dense_ids


#: Chunks of a block.
BLOCK_CHUNKS = 4_096


@dataclass
class Index:
    """An index of one modality.  ``colour_bins`` is 0 where histograms hold no colours."""

    modality: str
    items: DataFrame
    chunks: DataFrame
    codebook: DataFrame
    postings: DataFrame
    norms: DataFrame
    k: int
    colour_bins: int = 0
    scaler: DataFrame | None = None
    analyzer: Analyzer | None = None
    blocks: DataFrame | None = None

    @property
    def hist_dim(self) -> int:
        return self.k + self.colour_bins

    def n_terms(self) -> int:
        return self.postings.select("word_idx").distinct().count()

    def n_postings(self) -> int:
        return self.postings.count()


def norms_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def posting_blocks(rows: DataFrame, unit: bool = False, size: int = BLOCK_CHUNKS) -> DataFrame:
    """(chunk_id, starts, words, weights): arrays of a block's chunks, of where each begins, and of its words and weights.

    ``rows`` has chunk_id, word_idx, weight.  Chunks are split into ranges of ids by one shuffle; ``unit`` brings every chunk
    to unit length.
    """
    n = range_partitions(rows.sparkSession)
    ranged = rows.select("chunk_id", "word_idx", "weight").repartitionByRange(n, "chunk_id").sortWithinPartitions("chunk_id", "word_idx")
    id_type = rows.schema["chunk_id"].dataType.simpleString()

    def pack(ids: np.ndarray, words: np.ndarray, weights: np.ndarray, last: bool) -> tuple[pd.DataFrame, int]:
        """Blocks of whole chunks, and how many rows they take."""
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, int)
        whole = len(first) if last else (len(first) - 1) // size * size
        edge = np.append(first, len(ids))
        if unit and whole:
            length = np.sqrt(np.add.reduceat(weights * weights, first))
            weights = weights / np.repeat(np.where(length > 0, length, 1), np.diff(edge))
        out = []
        for lo in range(0, whole, size):
            hi = min(lo + size, whole)
            a, b = edge[lo], edge[hi]
            out.append((ids[edge[lo:hi]], (edge[lo : hi + 1] - a).astype(np.int32), words[a:b], weights[a:b]))
        return pd.DataFrame(out, columns=["chunk_id", "starts", "words", "weights"]), int(edge[whole])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for batch in batches:
            part = [batch["chunk_id"].to_numpy(), batch["word_idx"].to_numpy(np.int32), batch["weight"].to_numpy(float)]
            held = [np.concatenate(x) for x in zip(held, part)] if held else part
            blocks, used = pack(*held, False)
            if len(blocks):
                held = [x[used:] for x in held]
                yield blocks
        if held and len(held[0]):
            yield pack(*held, True)[0]

    return ranged.mapInPandas(run, f"chunk_id array<{id_type}>, starts array<int>, words array<int>, weights array<double>")


def postings_of_blocks(blocks: DataFrame) -> DataFrame:
    """(word_idx, chunk_id, weight) of blocks."""
    told = F.explode(F.arrays_zip("chunk_id", F.slice("starts", 1, F.size("starts") - 1).alias("a"), F.slice("starts", 2, F.size("starts") - 1).alias("b")))
    rows = blocks.select(told.alias("c"), "words", "weights")
    part = lambda x: F.slice(x, F.col("c.a") + 1, F.col("c.b") - F.col("c.a"))
    pairs = F.explode(F.arrays_zip(part("words").alias("w"), part("weights").alias("x"))).alias("p")
    return rows.select(F.col("c.chunk_id").alias("chunk_id"), pairs).select(F.col("p.w").alias("word_idx"), "chunk_id", F.col("p.x").alias("weight"))


def sorted_postings(rows: DataFrame) -> DataFrame:
    """Postings in ranges of words, sorted within; row groups then hold few words each."""
    n = range_partitions(rows.sparkSession)
    ranged = rows.select("word_idx", "chunk_id", "weight").repartitionByRange(n, "word_idx", "chunk_id")
    return ranged.sortWithinPartitions("word_idx", "chunk_id")


def posting_lists(postings: DataFrame, size: int = BLOCK_CHUNKS) -> DataFrame:
    """(word_idx, part, postings): the chunks of every word in order, in parts of ``size`` ids.  For inspection.

    A word that half of all chunks hold is many rows.
    """
    listed = F.array_sort(F.collect_list(F.struct("chunk_id", "weight"))).alias("postings")
    return postings.groupBy("word_idx", F.expr(f"chunk_id div {size}").alias("part")).agg(listed)


def build_text_index(
    items: DataFrame, k: int = cb.CodebookSizes.text_build, analyzer: Analyzer = Analyzer(), text_col: str = "lyrics", min_chars: int = 1
) -> Index:
    """Items (item_id, text, any metadata) to paragraphs, terms, codebook, histograms and postings."""
    # the ranges are found by the ids alone; texts are split where they end up
    ranged = items.select("item_id", text_col).repartitionByRange(range_partitions(items.sparkSession), "item_id")
    chunks = dense_ids(paragraph_chunks(ranged, "item_id", text_col, min_chars), ["item_id", "position"], "chunk_id", in_ranges=True)
    counts = materialize(cb.count_terms(analyzer.exploded(chunks, "content", "chunk_id")), "counts")
    words = materialize(cb.text_codebook(cb.term_statistics(counts), chunks.count(), k), "codebook")
    return of_weights("text", items.drop(text_col), chunks, words, hg.weighted_terms(counts, words, ["chunk_id"]), k, analyzer=analyzer)


def text_words(items: DataFrame, k: int, analyzer: Analyzer = Analyzer(), text_col: str = "lyrics", min_chars: int = 1) -> DataFrame:
    """The codebook of items alone: chunks are told by item and position, and nothing else is built."""
    chunks = paragraph_chunks(items, "item_id", text_col, min_chars)
    terms = analyzer.exploded(chunks, "content", "item_id", "position").withColumn("chunk_id", F.struct("item_id", "position"))
    counts = materialize(cb.count_terms(terms), "counts")
    return cb.text_codebook(cb.term_statistics(counts), chunks.count(), k)


def of_weights(modality: str, items: DataFrame, chunks: DataFrame, words: DataFrame, weights: DataFrame, k: int, unit: bool = True, **more) -> Index:
    """An index of weights (chunk_id, word_idx, weight)."""
    blocks = materialize(posting_blocks(weights, unit), "blocks")
    postings = postings_of_blocks(blocks)
    return Index(modality, items, chunks, words, postings, norms_of(postings), k, blocks=blocks, **more)


def build_vector_index(
    items: DataFrame,
    modality: str,
    k: int,
    descriptors_col: str = "descriptors",
    colour_col: str | None = None,
    alpha: float = 0.5,
    standardise: bool = True,
    centroids: DataFrame | None = None,
    sample: int = cb.CodebookSizes.sample,
    seed: int = 0,
) -> Index:
    """Items (item_id, descriptors[, colour], any metadata) to an index; an item is one chunk.

    ``centroids`` (word_idx, vec over standardised descriptors) replaces the training.
    """
    rows = items.select("item_id", F.posexplode(descriptors_col).alias("pos", "vec"))
    rows = materialize(rows, "descriptors")
    if rows.isEmpty():
        raise ValueError("no item has a descriptor")
    picked = cb.descriptor_sample(rows, ["item_id", "pos"], sample, seed)
    scaler = materialize(cb.z_fit(picked), "scaler") if standardise else None
    scaled = cb.z_apply(rows, scaler) if standardise else rows
    if centroids is None:
        centroids = cb.k_means(cb.descriptor_sample(scaled, ["item_id", "pos"], sample, seed), k, seed)
    assigned = materialize(cb.assign(scaled, centroids).select("item_id", "word_idx"), "assigned")
    words = centroids.join(cb.visual_idf(assigned, centroids), "word_idx")
    words = materialize(words.select("word_idx", "vec", "df", "idf"), "codebook")
    hist = hg.histograms(assigned, words, ["item_id"], on="word_idx")
    size, bins = words.count(), 0
    if colour_col is not None and alpha > 0:
        bins = items.select(F.max(F.size(colour_col)).alias("n")).first()["n"] or 0
        hist = hg.fuse_colour(hist, hg.sparse_of_dense(items, "item_id", colour_col), size, alpha, ["item_id"])
    drop = [c for c in (descriptors_col, colour_col) if c]
    chunks = items.select(F.col("item_id").alias("chunk_id"), "item_id", F.lit(0).alias("position"), F.lit(None).cast("string").alias("content"))
    weights = hist.withColumnRenamed("item_id", "chunk_id")
    return of_weights(modality, items.drop(*drop), chunks, words, weights, size, unit=False, colour_bins=bins, scaler=scaler)


def index_of_histograms(df: DataFrame, id_col: str, vec_col: str, modality: str, items: DataFrame, item_of_chunk: DataFrame) -> Index:
    """An index over stored dense histograms: rows (id, array).  ``item_of_chunk`` has chunk_id and item_id."""
    postings = hg.sparse_of_dense(df, id_col, vec_col).withColumnRenamed(id_col, "chunk_id")
    k = df.select(F.max(F.size(vec_col)).alias("n")).first()["n"] or 0
    none = df.sparkSession.createDataFrame([], "word_idx int, idf double")
    return of_weights(modality, items, item_of_chunk, none, postings, k, unit=False)
