"""Indexes on disk: five tables, partitioned by app and modality, and a small description.

Writing replaces one (app, modality) and leaves the others alone.  The tables are written into a
folder of a new version first; the description names the version and is written last, so a reader
sees the old index or the new one, never a part.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions.text import Analyzer
from kelpline.operators import histogram as hg
from kelpline.operators.index import Index, sorted_postings
from kelpline.plans.planner import IndexNotBuilt

TABLES = ["items", "chunks", "codebook", "blocks", "postings", "norms", "histograms", "scaler"]


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def _describe(spark: SparkSession, path: str, told: dict) -> None:
    hadoop, fs = _fs(spark, path)
    out = fs.create(hadoop, True)
    out.write(bytearray(json.dumps(told).encode()))
    out.close()


def _description(spark: SparkSession, path: str) -> dict | None:
    hadoop, fs = _fs(spark, path)
    if not fs.exists(hadoop):
        return None
    return json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))


def save(index: Index, path: str, app: str = "default", dense_histograms: bool = True) -> DataFrame:
    """Replace the index of (app, modality) below ``path``; returns (table, rows) of what was written."""
    spark = index.postings.sparkSession
    base = f"{path}/app={app}/modality={index.modality}"
    old = _description(spark, f"{base}/description.json")
    version = uuid.uuid4().hex[:12]
    items = index.items
    if "external_id" in items.columns:
        items = items.withColumn("external_id", F.col("external_id").cast("string"))
    parts: dict[str, DataFrame] = {
        "items": items,
        "chunks": index.chunks,
        "codebook": index.codebook,
        "blocks": index.blocks,
        "postings": sorted_postings(index.postings),
        "norms": index.norms,
    }
    if dense_histograms and index.hist_dim:
        parts["histograms"] = hg.dense_of_sparse(index.postings, "chunk_id", index.hist_dim)
    if index.scaler is not None:
        parts["scaler"] = index.scaler
    for name, df in parts.items():
        df.write.parquet(f"{base}/{version}/{name}")
    told = {
        "version": version,
        "k": index.k,
        "colour_bins": index.colour_bins,
        "analyzer": None if index.analyzer is None else vars(index.analyzer),
        "tables": list(parts),
    }
    _describe(spark, f"{base}/description.json", told)
    if old:
        hadoop, fs = _fs(spark, f"{base}/{old['version']}")
        fs.delete(hadoop, True)
    return summary(spark, path, index.modality, app)


def load(spark: SparkSession, path: str, modality: str, app: str = "default") -> Index:
    """The index of (app, modality); IndexNotBuilt where there is none."""
    base = f"{path}/app={app}/modality={modality}"
    told = _description(spark, f"{base}/description.json")
    if told is None:
        raise IndexNotBuilt(f"there is no {modality} index below {path}")
    read = {name: spark.read.parquet(f"{base}/{told['version']}/{name}") for name in told["tables"]}
    return Index(
        modality, read["items"], read["chunks"], read["codebook"], read["postings"], read["norms"], told["k"],
        told["colour_bins"], read.get("scaler"), Analyzer(**told["analyzer"]) if told["analyzer"] else None, read["blocks"],
    )


def load_histograms(spark: SparkSession, path: str, modality: str, app: str = "default") -> DataFrame:
    """(item columns..., chunk_id, hist): stored dense histograms with their items."""
    base = f"{path}/app={app}/modality={modality}"
    told = _description(spark, f"{base}/description.json")
    if told is None or "histograms" not in told["tables"]:
        raise IndexNotBuilt(f"there are no {modality} histograms below {path}")
    read = {name: spark.read.parquet(f"{base}/{told['version']}/{name}") for name in ("histograms", "chunks", "items")}
    return read["histograms"].join(read["chunks"].select("chunk_id", "item_id"), "chunk_id").join(read["items"], "item_id")


def summary(spark: SparkSession, path: str, modality: str, app: str = "default") -> DataFrame:
    """(table, rows) of the stored tables."""
    base = f"{path}/app={app}/modality={modality}"
    told = _description(spark, f"{base}/description.json")
    if told is None:
        raise IndexNotBuilt(f"there is no {modality} index below {path}")
    out = None
    for name in told["tables"]:
        if name == "blocks":  # the same numbers as the postings
            continue
        one = spark.read.parquet(f"{base}/{told['version']}/{name}").agg(F.count(F.lit(1)).alias("rows"))
        one = one.select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def drop(spark: SparkSession, path: str, modality: str, app: str = "default") -> None:
    hadoop, fs = _fs(spark, f"{path}/app={app}/modality={modality}")
    fs.delete(hadoop, True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of everything below a path."""
    hadoop, fs = _fs(spark, path)
    return int(fs.getContentSummary(hadoop).getLength()) if fs.exists(hadoop) else 0
