"""Songs from JSON, Parquet or CSV, with columns under several names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.runtime import materialize, range_partitions

#: Names under which each column may come, the first present one wins.
ALIASES = {
    "external_id": ["external_id", "link", "id", "track_id", "uri"],
    "title": ["title", "song", "name", "track", "track_name"],
    "artist": ["artist", "artists", "artist_name", "track_artist", "performer"],
    "lyrics": ["lyrics", "text", "content", "lyric"],
}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By the ending of the path: an array of JSON objects, Parquet, or CSV with quoted line breaks.

    A JSON array and a CSV file are read by one task each, as neither says where it can be cut; a large collection
    comes as many files, or as ``jsonl`` (an object a line), which is cut like Parquet.
    """
    ending = re.sub(r"/+$", "", path).rsplit(".", 1)[-1].lower()
    if ending == "json":
        return spark.read.json(path, multiLine=True)
    if ending == "jsonl":
        return spark.read.json(path)
    if ending == "parquet":
        return spark.read.parquet(path)
    if ending == "csv":
        return spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"')
    raise ValueError(f"no reader for .{ending}; there are json, jsonl, parquet and csv")


def map_columns(df: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """One column per alias list, whatever the case of its name; null where none is present.

    A present column wins even where its value is null.
    """
    present = {c.lower(): c for c in reversed(df.columns)}
    chosen = {to: next((present[a] for a in names if a in present), None) for to, names in aliases.items()}
    return df.select(
        *[(F.lit(None) if c is None else F.col(f"`{c}`")).cast("string").alias(to) for to, c in chosen.items()]
    )


def dense_ids(df: DataFrame, order: list[str], name: str = "item_id", in_ranges: bool = False) -> DataFrame:
    """Ids 0, 1, 2, ... by ``order``, without sorting everything in one task.

    Rows are split into ranges and numbered by their place within them, which the size of the ranges before shifts: one
    shuffle, one write.  ``in_ranges`` says that ``df`` is partitioned by ranges of the first of ``order`` already.
    """
    ranged = df if in_ranges else df.repartitionByRange(range_partitions(df.sparkSession), *order)
    ranged = ranged.sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranged")
    part = F.shiftright("_place", 33)  # the upper bits are the partition, the lower ones the place in it
    sizes = ranged.groupBy(part.alias("_part")).count().collect()  # one row per partition
    shift, so_far = [], 0
    for p, n in sorted(sizes):
        shift.append((p, so_far))
        so_far += n
    offsets = df.sparkSession.createDataFrame(shift or [(0, 0)], "_part long, _shift long")
    in_part = F.col("_place").bitwiseAND((1 << 33) - 1)
    return (
        ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_shift") + in_part).drop("_part", "_place", "_shift")
    )


def fill_external_id(df: DataFrame, ordinal: str) -> DataFrame:
    """Null, empty and 0 external ids become the row's ordinal as a string; NaN stays."""
    ext = F.col("external_id")
    return df.withColumn("external_id", F.when(ext.isNull() | ext.isin("", "0", "0.0"), F.col(ordinal).cast("string")).otherwise(ext))


def load_songs(spark: SparkSession, path: str, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """(item_id, external_id, title, artist, lyrics) of a file of songs, in the order of ``order``.

    ``order`` names raw columns; without it rows are ordered by their mapped values.
    """
    raw = read_table(spark, path)
    keys = order or []
    mapped = map_columns(raw).columns
    present = {c.lower(): c for c in reversed(raw.columns)}
    source = {to: next((present[a] for a in names if a in present), None) for to, names in ALIASES.items()}
    rows = raw.select(
        *[(F.lit(None) if source[c] is None else F.col(f"`{source[c]}`")).cast("string").alias(c) for c in mapped],
        *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keys)],
    )
    by = [f"_k{i}" for i in range(len(keys))] or mapped
    if limit is not None:
        rows = rows.orderBy(*by).limit(limit)
    return fill_external_id(dense_ids(rows, by), "item_id").select("item_id", *mapped)
