"""Nearest dense vectors: exact by scan, approximate by the cells of a stored index."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kelpline.functions.vectors import cosine_distance, norm, usable
from kelpline.operators import codebook as cb
from kelpline.runtime import range_partitions

#: Most query vectors that one scan of all rows is compared with; larger sets go in blocks.
QUERY_BLOCK = 4096
#: Rows compared at once: a task holds a matrix of so many rows by a block of queries.
ROW_BLOCK = 512


class _Nearest:
    """The ``k`` nearest rows of every query that a task has seen: by rounded distance, then by id."""

    def __init__(self, k: int, digits: int):
        self.k, self.digits, self.size, self.kept = k, digits, 0, []

    def add(self, dist: np.ndarray, ids: np.ndarray, which: np.ndarray) -> None:
        """``dist`` holds queries, numbered ``which``, by rows ``ids``; infinite distances do not count."""
        ranked = np.round(dist, self.digits)
        least = np.partition(ranked, self.k - 1, axis=1)[:, [self.k - 1]] if self.k < ranked.shape[1] else np.inf
        x, y = np.nonzero(np.isfinite(ranked) & (ranked <= least))
        self.kept.append((which[x], ids[y], dist[x, y]))
        self.size += len(x)
        if self.size > 1_000_000:
            self.kept = [self.best()]
            self.size = len(self.kept[0][0]) // 2  # where all of it is needed, the next cut comes later

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, ids, dist = (np.concatenate(p) for p in zip(*self.kept))
        order = np.lexsort((ids, np.round(dist, self.digits), q))
        begins = np.flatnonzero(np.append(True, np.diff(q[order]) != 0)) if len(q) else np.zeros(0, int)
        place = np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q))))
        order = order[place < self.k]
        return q[order], ids[order], dist[order]


def _units(vectors) -> np.ndarray:
    m = np.stack(list(vectors)).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _in_blocks(queries: DataFrame, vec_col: str, search: Callable[[dict], DataFrame], none: DataFrame) -> DataFrame:
    """Union of ``search`` over blocks of queries: {length: (ids, unit vectors)}."""
    found, block, n = None, {}, 0

    def flush() -> None:
        nonlocal found, block, n
        part = search({size: (np.asarray(ids), _units(q)) for size, (ids, q) in block.items()})
        found = part if found is None else found.unionByName(part)
        block, n = {}, 0

    for r in queries.toLocalIterator():
        ids, q = block.setdefault(len(r[vec_col]), ([], []))
        ids.append(r["query_id"])
        q.append(r[vec_col])
        n += 1
        if n >= QUERY_BLOCK:
            flush()
    if n:
        flush()
    return none if found is None else found


def exact(
    vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, exclude_self: bool = True, digits: int = 6
) -> DataFrame:
    """(query_id, id_col, dist, place): the ``k`` rows of least cosine distance to every query.

    ``queries`` has query_id and ``vec_col``; all rows are compared with all queries of a block, and
    every task keeps k rows per query before the shuffle.  Vectors that are null, all zero, hold NaN or
    have another length are left out on both sides.  Ties by id.
    """
    spark = vectors.sparkSession
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema[id_col].dataType.simpleString()}, dist double"
    asked = queries.where(usable(F.col(vec_col))).select("query_id", vec_col)
    rows = vectors.where(usable(F.col(vec_col))).select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_vec"))

    def search(block: dict) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            near = {size: _Nearest(k, digits) for size in sent.value}
            for batch in batches:
                for size, part in batch.groupby(batch["_vec"].map(len)):
                    if size not in near:
                        continue
                    q_ids, q = sent.value[size]
                    for lo in range(0, len(part), ROW_BLOCK):
                        some = part.iloc[lo : lo + ROW_BLOCK]
                        ids, dist = some["_id"].to_numpy(), 1 - q @ _units(some["_vec"]).T
                        if exclude_self:
                            dist[q_ids[:, None] == ids[None, :]] = np.inf
                        near[size].add(dist, ids, np.arange(len(q)))
            for size, found in near.items():
                if found.kept:
                    x, ids, dist = found.best()
                    yield pd.DataFrame({"query_id": sent.value[size][0][x], "id": ids, "dist": dist})

        return rows.mapInPandas(run, schema)

    found = _in_blocks(asked, vec_col, search, spark.createDataFrame([], schema))
    return _placed(found, k, digits).withColumnRenamed("id", id_col)


def _placed(found: DataFrame, k: int, digits: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.round("dist", digits), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def by_example(vectors: DataFrame, probe_id, k: int, id_col: str, vec_col: str) -> DataFrame:
    """Neighbours of one stored row, itself left out; an unknown probe gives no rows.

    The probe is one broadcast row, the rest a scan with a top-k.
    """
    probe = vectors.where(F.col(id_col) == F.lit(probe_id)).where(usable(F.col(vec_col))).limit(1)
    one = F.broadcast(probe.select(F.col(vec_col).alias("_q"), norm(F.col(vec_col)).alias("_qn")))
    rows = vectors.where(usable(F.col(vec_col))).where(F.col(id_col) != F.lit(probe_id))
    rows = rows.join(one, F.size(vec_col) == F.size("_q"))
    scored = rows.withColumn("dist", cosine_distance(F.col(vec_col), F.col("_q"), norm_b=F.col("_qn")))
    return scored.drop("_q", "_qn").orderBy(F.round("dist", 6), id_col).limit(k)


def items_of_chunks(hits: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """(query_id, item_id, dist, score, place): the least distance of each item's chunks, cut to ``n`` items."""
    least = hits.join(chunks.select("chunk_id", "item_id").distinct(), "chunk_id").groupBy("query_id", "item_id").agg(F.min("dist").alias("dist"))
    order = W.partitionBy("query_id").orderBy(F.round("dist", 6), "item_id")
    best = least.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return best.withColumn("score", F.round(1 - F.col("dist"), 4))


# -- approximate: an index of cells -------------------------------------------------------------------


@dataclass
class CellIndex:
    """``centres`` (word_idx, vec); ``cells`` (cell, id, vec): unit vectors in ranges of cells, as stored below ``path``."""

    path: str
    centres: DataFrame
    cells: DataFrame

    def sizes(self) -> DataFrame:
        """(cell, n)."""
        return self.cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def build_cells(vectors: DataFrame, id_col: str, vec_col: str, path: str, n_cells: int | None = None, sample: int = 100_000, seed: int = 0) -> CellIndex:
    """Build an index below ``path``, in place of one that is there, and return it.

    The centres are fitted on at most ``sample`` vectors; every usable vector is put into the cell of its nearest
    centre.  ``n_cells`` is by default the square root of their number, at most 16,384.  All vectors must have one length.
    """
    unit = F.pandas_udf(lambda v: pd.Series(list(_units(v))) if len(v) else pd.Series([], dtype=object), "array<double>")
    rows = vectors.where(usable(F.col(vec_col))).select(F.col(id_col).alias("id"), unit(F.col(vec_col)).alias("vec"))
    n = rows.select("id").count()
    if n == 0:
        raise ValueError("there is no usable vector")
    k = n_cells or max(1, min(16_384, round(n**0.5)))
    centres = cb.k_means(cb.descriptor_sample(rows, ["id"], sample, seed), k, seed)
    centres.write.mode("overwrite").parquet(f"{path}/centres")
    placed = cb.assign(rows, centres).select(F.col("word_idx").alias("cell"), "id", "vec")
    # ranges of (cell, id), so a cell of many vectors is many files
    ranged = placed.repartitionByRange(range_partitions(vectors.sparkSession), "cell", "id").sortWithinPartitions("cell", "id")
    ranged.write.mode("overwrite").parquet(f"{path}/cells")
    return load_cells(vectors.sparkSession, path)


def load_cells(spark, path: str) -> CellIndex:
    return CellIndex(path, spark.read.parquet(f"{path}/centres"), spark.read.parquet(f"{path}/cells"))


def drop_cells(index: CellIndex) -> None:
    spark = index.cells.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(index.path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _probed(q: np.ndarray, centres: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` nearest centres of every query."""
    near = q @ centres.T - (centres * centres).sum(1) / 2
    return np.argsort(-np.round(near, 9), axis=1, kind="stable")[:, :depth]


def search_cells(index: CellIndex, queries: DataFrame, k: int, depth: int, vec_col: str, id_name: str = "id", exclude_self: bool = True, digits: int = 6) -> DataFrame:
    """(query_id, id_name, dist, place): the nearest rows among the ``depth`` cells nearest to each query.

    Only the cells that some query of a block needs are read (a filter on ``cell`` that reaches the scan); rows are compared
    with the queries that look into their cell, and a task keeps k rows per query.
    """
    spark = queries.sparkSession
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {index.cells.schema['id'].dataType.simpleString()}, dist double"
    told = sorted((r["word_idx"], list(r["vec"])) for r in index.centres.collect())  # at most 16,384 rows
    centres = np.array([v for _, v in told])
    asked = queries.where(usable(F.col(vec_col)) & (F.size(vec_col) == centres.shape[1])).select("query_id", vec_col)

    def search(block: dict) -> DataFrame:
        ((q_ids, q),) = block.values()
        probed = _probed(q, centres, depth)
        needed = np.unique(probed)
        who = {int(c): np.flatnonzero((probed == c).any(1)) for c in needed}
        sent = spark.sparkContext.broadcast((q_ids, q, who))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q_ids, q, who = sent.value
            near = _Nearest(k, digits)
            for batch in batches:
                for cell, part in batch.groupby("cell"):
                    which = who.get(int(cell))
                    for lo in range(0, len(part) if which is not None else 0, ROW_BLOCK):
                        some = part.iloc[lo : lo + ROW_BLOCK]
                        ids, dist = some["id"].to_numpy(), 1 - q[which] @ np.stack(some["vec"].to_list()).T
                        if exclude_self:
                            dist[q_ids[which][:, None] == ids[None, :]] = np.inf
                        near.add(dist, ids, which)
            if near.kept:
                x, ids, dist = near.best()
                yield pd.DataFrame({"query_id": q_ids[x], "id": ids, "dist": dist})

        few = len(needed) <= 1_000 and len(needed) < len(centres)
        rows = index.cells.where(F.col("cell").isin([int(c) for c in needed])) if few else index.cells
        return rows.mapInPandas(run, schema)

    found = _in_blocks(asked, vec_col, search, spark.createDataFrame([], schema))
    return _placed(found, k, digits).withColumnRenamed("id", id_name)


def compared_share(index: CellIndex, queries: DataFrame, depth: int, vec_col: str) -> DataFrame:
    """(share): mean share of all vectors that a search of this depth compares with a query."""
    told = sorted((r["word_idx"], list(r["vec"])) for r in index.centres.collect())
    centres = np.array([v for _, v in told])
    probes = F.pandas_udf(lambda v: pd.Series(list(_probed(_units(v), centres, depth).astype(np.int32))) if len(v) else pd.Series([], dtype=object), "array<int>")
    asked = queries.where(usable(F.col(vec_col))).select(F.col("query_id"), F.explode(probes(F.col(vec_col))).alias("cell"))
    sizes = index.sizes()
    every = sizes.agg(F.sum("n").alias("_all"))
    per = asked.join(F.broadcast(sizes), "cell").groupBy("query_id").agg(F.sum("n").alias("n"))  # one row a cell
    return per.join(F.broadcast(every)).agg(F.avg(F.col("n") / F.col("_all")).alias("share"))


def dense_items(index, query: DataFrame, n: int) -> DataFrame:
    """(query_id, item_id, dist, score, place): least cosine distance over all chunks of every item, ``n`` items.

    ``query`` holds sparse query histograms; a query without words gives nothing.  Chunks that share no word
    with a query have distance 1, so they only matter where fewer than ``n`` items share one: then the items
    of the smallest ids fill up.  Of these, the first 2 n ids hold enough.
    """
    from kelpline.operators.search import cosine_scores

    hits = cosine_scores(query, index.postings, index.norms).join(index.chunks.select("chunk_id", "item_id"), "chunk_id")
    best = hits.groupBy("query_id", "item_id").agg(F.max("score").alias("s"))
    asked = query.select("query_id").distinct()
    first = [r["item_id"] for r in index.chunks.select("item_id").distinct().orderBy("item_id").limit(2 * n).collect()]
    fill = asked.select("query_id", F.explode(F.lit(first or [0])).alias("item_id"), F.lit(0.0).alias("s")) if first else best.limit(0)
    every = best.unionByName(fill.select("query_id", "item_id", "s")).groupBy("query_id", "item_id").agg(F.max("s").alias("s"))
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("s", 6)), "item_id")
    placed = every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return placed.select("query_id", "item_id", (1 - F.col("s")).alias("dist"), F.round("s", 4).alias("score"), "place")
