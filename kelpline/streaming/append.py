"""Continuous ingestion: new items become chunks and blocks under a frozen codebook, which can be searched with the rest."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kelpline.operators import codebook as cb
from kelpline.operators import histogram as hg
from kelpline.operators.index import Index, norms_of, posting_blocks, postings_of_blocks
from kelpline.operators.split import paragraph_chunks
from kelpline.sources.songs import dense_ids


def _appended(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.parquet(f"{path}/{name}")


def _first_id(index: Index, path: str, epoch: int) -> int:
    """Chunks are numbered on from the index and the batches before."""
    last = index.chunks.agg(F.max("chunk_id").alias("m")).first()["m"]
    start = 0 if last is None else last + 1
    before = _appended(index.chunks.sparkSession, path, "chunks")
    top = None if before is None else before.where(F.col("epoch") < epoch).agg(F.max("chunk_id").alias("m")).first()["m"]
    return start if top is None else max(start, top + 1)


def append_stream(items: DataFrame, index: Index, id_col: str, text_col: str, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's items, chunks and blocks below ``path``; a batch that is run again replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumnRenamed(id_col, "item_id")
        chunks = dense_ids(paragraph_chunks(rows, "item_id", text_col), ["item_id", "position"], "chunk_id")
        chunks = chunks.withColumn("chunk_id", F.col("chunk_id") + _first_id(index, path, epoch))
        counts = cb.count_terms(index.analyzer.exploded(chunks, "content", "chunk_id"))
        blocks = posting_blocks(hg.weighted_terms(counts, index.codebook, ["chunk_id"]), unit=True)
        # the chunks, by which later batches are numbered, come last
        for name, df in (("items", rows.drop(text_col)), ("blocks", blocks), ("chunks", chunks)):
            df.write.mode("overwrite").parquet(f"{path}/{name}/epoch={epoch}")

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def grown_index(index: Index, path: str) -> Index:
    """The index together with all that was appended below ``path``."""
    spark = index.chunks.sparkSession
    new = {name: _appended(spark, path, name) for name in ("items", "chunks", "blocks")}
    if any(df is None for df in new.values()):
        return index
    both = {name: getattr(index, name).unionByName(df.drop("epoch"), allowMissingColumns=True) for name, df in new.items()}
    postings = postings_of_blocks(both["blocks"])
    return replace(index, **both, postings=postings, norms=norms_of(postings))
