"""Cosine search over postings, for one query or a batch of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kelpline.operators import histogram as hg
from kelpline.operators.index import Index

#: Query histograms of up to so many rows are sent to every task; larger batches are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Most queries that one scan of the blocks answers; larger batches go in blocks of queries.
QUERY_BLOCK = 4_096
#: Numbers of a dense part of a block.
DENSE = 4_000_000
#: Scores are compared after rounding to this many digits, so sums in another order rank alike.
DIGITS = 6


def quantise_text(index: Index, queries: DataFrame, text_col: str = "text") -> DataFrame:
    """(query_id, word_idx, weight) of query texts, by the index's analyzer and codebook."""
    terms = index.analyzer.exploded(queries, text_col, "query_id")
    return hg.histograms(terms, index.codebook, ["query_id"])


def quantise_descriptors(index: Index, queries: DataFrame, descriptors_col: str = "descriptors", colour_col: str | None = None, alpha: float = 0.5) -> DataFrame:
    """(query_id, word_idx, weight) of query descriptors; colours count only if index and query have them."""
    from kelpline.operators import codebook as cb

    rows = queries.select("query_id", F.explode(descriptors_col).alias("vec"))
    if index.scaler is not None:
        rows = cb.z_apply(rows, index.scaler)
    hist = hg.histograms(cb.assign(rows, index.codebook), index.codebook, ["query_id"], on="word_idx")
    if index.colour_bins and colour_col is not None:
        return hg.fuse_colour(hist, hg.sparse_of_dense(queries, "query_id", colour_col), index.k, alpha, ["query_id"])
    return hist


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def cosine_scores(query: DataFrame, postings: DataFrame, norms: DataFrame | None) -> DataFrame:
    """(query_id, chunk_id, score) of all chunks that share a word with a query.

    Missing or zero norms count as 1.  Products are summed before the shuffle.
    """
    lengths = query.groupBy("query_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_q"))
    rows = postings.join(_small(query.withColumnRenamed("weight", "_w")), "word_idx")
    summed = rows.groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * F.col("_w")).alias("score"))
    summed = summed.join(_small(lengths), "query_id")
    if norms is not None:
        summed = summed.join(norms, "chunk_id", "left")
        below = F.coalesce(F.nullif("norm", F.lit(0.0)), F.lit(1.0)) * F.coalesce(F.nullif("_q", F.lit(0.0)), F.lit(1.0))
    else:
        below = F.coalesce(F.nullif("_q", F.lit(0.0)), F.lit(1.0))
    return summed.select("query_id", "chunk_id", (F.col("score") / below).alias("score"))


def top_per_query(scores: DataFrame, n: int, id_col: str = "chunk_id", digits: int = DIGITS) -> DataFrame:
    """The ``n`` best rows of every query with ``place`` from 1; ties by id."""
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), id_col)
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Row numbers of the ``n`` best of every query: by rounded score, then by id."""
    order = np.lexsort((ids, -np.round(score, DIGITS), q))
    q = q[order]
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[place < n]


def _scan(sent, n: int):
    """The ``n`` best chunks of every query within a task's blocks."""

    def of_block(row, q: np.ndarray, column: np.ndarray):
        """(query, chunk, score) of the best chunks of one block."""
        ids, starts = np.asarray(row.chunk_id), np.asarray(row.starts)
        words, weights = np.asarray(row.words), np.asarray(row.weights)
        at = np.where(words < len(column), column[np.minimum(words, len(column) - 1)], -1)
        use = np.flatnonzero(at >= 0)
        owner = np.repeat(np.arange(len(ids)), np.diff(starts))[use]
        length = np.sqrt(np.bincount(np.repeat(np.arange(len(ids)), np.diff(starts)), weights * weights, len(ids)))
        at, weights = at[use], weights[use]
        step = max(1, DENSE // max(q.shape))
        for lo in range(0, len(ids), step):
            a, b = np.searchsorted(owner, [lo, lo + step])
            if a == b:
                continue
            dense = np.zeros((min(step, len(ids) - lo), q.shape[1]))
            dense[owner[a:b] - lo, at[a:b]] = weights[a:b]
            norm = length[lo : lo + step]
            score = q @ dense.T / np.where(norm > 0, norm, 1)
            if (q < 0).any() or (weights < 0).any():  # a score of 0 or less can come from words that are shared
                shared = (q != 0).astype(float) @ (dense != 0).astype(float).T > 0
            else:
                shared = score > 0
            ranked = np.where(shared, np.round(score, DIGITS), -np.inf)
            least = np.partition(ranked, -n, axis=1)[:, [-n]] if n < ranked.shape[1] else np.float64(-np.inf)
            x, y = np.nonzero(shared & (ranked >= least))
            best = _best(x, y, score[x, y], n)
            yield x[best], ids[lo + y[best]], score[x[best], y[best]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q, column = sent.value
        kept: list[tuple] = []

        def reduce() -> tuple:
            x, ids, score = (np.concatenate(part) for part in zip(*kept))
            best = _best(x, ids, score, n)
            return x[best], ids[best], score[best]

        for batch in batches:
            for row in batch.itertuples(index=False):
                kept += of_block(row, q, column)
                if len(kept) > 16:
                    kept = [reduce()]
        if kept:
            x, ids, score = reduce()
            yield pd.DataFrame({"query_id": q_ids[x], "chunk_id": ids, "score": score})

    return run


def best_chunks(index: Index, query: DataFrame, n: int) -> DataFrame:
    """(query_id, chunk_id, score) with the ``n`` best chunks of every query, and a few more of other tasks.

    Queries (query_id, word_idx, weight) are sent in blocks of ``QUERY_BLOCK``.  A block of chunks is multiplied with all of
    them at once; a task keeps the ``n`` best of each query, so no scored pair is shuffled but these.
    """
    spark = query.sparkSession
    q_type, c_type = query.schema["query_id"].dataType.simpleString(), index.postings.schema["chunk_id"].dataType.simpleString()
    schema = f"query_id {q_type}, chunk_id {c_type}, score double"
    packed = query.groupBy("query_id").agg(F.collect_list(F.struct("word_idx", "weight")).alias("h"))  # a histogram has at most k words
    found: list[DataFrame] = []

    def scan(rows: list) -> None:
        words = np.unique([w["word_idx"] for r in rows for w in r["h"]])
        column = np.full(int(words.max()) + 1, -1, dtype=np.int32)
        column[words] = np.arange(len(words))
        q = np.zeros((len(rows), len(words)))
        for i, r in enumerate(rows):
            for w in r["h"]:
                q[i, column[w["word_idx"]]] += w["weight"]
        length = np.linalg.norm(q, axis=1, keepdims=True)
        q /= np.where(length > 0, length, 1)
        sent = spark.sparkContext.broadcast((np.array([r["query_id"] for r in rows]), q, column))
        found.append(index.blocks.mapInPandas(_scan(sent, n), schema))

    block: list = []
    for r in packed.toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            scan(block)
            block = []
    if block:
        scan(block)
    out = found[0] if found else spark.createDataFrame([], schema)
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def search_chunks(index: Index, query: DataFrame, n: int = 10) -> DataFrame:
    """(query_id, chunk_id, score, place); queries without a known word have no rows."""
    return top_per_query(best_chunks(index, query, n), n)


def best_chunk_per_item(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Of every query and item the best chunk: (query_id, item_id, chunk_id, score)."""
    joined = hits.join(chunks.select("chunk_id", "item_id"), "chunk_id")
    order = W.partitionBy("query_id", "item_id").orderBy(F.desc(F.round("score", DIGITS)), "chunk_id")
    return joined.withColumn("_best", F.row_number().over(order)).where("_best = 1").select("query_id", "item_id", "chunk_id", "score")


def search_text_items(index: Index, queries: DataFrame, n: int = 10, over_fetch: int | None = 5, text_col: str = "text") -> DataFrame:
    """(query_id, place, item_id, score, chunk_id, content, item columns...): best chunk of the ``n`` best items.

    Only ``over_fetch`` * n chunks are rolled up, so fewer than ``n`` items can come out; None rolls up all.
    """
    query = quantise_text(index, queries, text_col)
    if over_fetch is None:
        scores = cosine_scores(query, index.postings, index.norms)
    else:
        scores = search_chunks(index, query, n * over_fetch).drop("place")
    best = top_per_query(best_chunk_per_item(scores, index.chunks), n, "item_id")
    told = best.join(index.chunks.select("chunk_id", "content"), "chunk_id").join(index.items, "item_id")
    extra = [c for c in index.items.columns if c != "item_id"]
    return told.select("query_id", "place", "item_id", F.round("score", 4).alias("score"), "chunk_id", "content", *extra)


def search_histograms(index: Index, query: DataFrame, n: int = 10, exclude: DataFrame | None = None) -> DataFrame:
    """(query_id, place, item_id, score, item columns...) for query histograms.

    ``exclude`` (query_id, chunk_id) are left out before the cut.  Metadata is looked up by a left join.
    """
    more = 0
    if exclude is not None:  # what is left out later may take so many places
        more = exclude.groupBy("query_id").count().agg(F.max("count").alias("m")).first()["m"] or 0
    scores = best_chunks(index, query, n + more)
    if exclude is not None:
        scores = scores.join(exclude, ["query_id", "chunk_id"], "left_anti")
    best = top_per_query(scores, n).join(index.chunks.select("chunk_id", "item_id"), "chunk_id", "left")
    told = best.join(index.items, "item_id", "left")
    extra = [c for c in index.items.columns if c != "item_id"]
    return told.select("query_id", "place", "item_id", "chunk_id", F.round("score", 4).alias("score"), *extra)


def search_like(index: Index, key_col: str, key: str, n: int = 10) -> DataFrame:
    """Items like the one whose ``key_col`` equals ``key`` (compared as strings), itself left out."""
    probe = index.items.where(F.col(key_col).cast("string") == str(key)).select("item_id")
    chunk = index.chunks.join(F.broadcast(probe.limit(1)), "item_id", "left_semi").orderBy("chunk_id").limit(1)
    query = index.postings.join(F.broadcast(chunk.select("chunk_id")), "chunk_id", "left_semi").select(
        F.lit(0).cast("long").alias("query_id"), "word_idx", "weight"
    )
    self_out = chunk.select(F.lit(0).cast("long").alias("query_id"), "chunk_id")
    return search_histograms(index, query, n, exclude=self_out)


def postings_visited(query: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, visited): postings of all words of a query."""
    df = postings.groupBy("word_idx").agg(F.count(F.lit(1)).alias("df"))
    return query.select("query_id", "word_idx").distinct().join(df, "word_idx").groupBy("query_id").agg(F.sum("df").alias("visited"))
