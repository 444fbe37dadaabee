"""Image folders, style tables and tables of audio features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions.audio import FEATURES

#: File endings that count as images.
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "bmp", "webp")


def scan_images(spark: SparkSession, folder: str, limit: int | None = None, content: bool = True) -> DataFrame:
    """(external_id, filename, path[, content]) of the images below a folder, ordered by path.

    Raises FileNotFoundError when there is none.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.where(F.lower("path").rlike(r"\.(" + "|".join(IMAGE_ENDINGS) + ")$"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    out = files.select(
        F.regexp_replace(name, r"\.[^.]+$", "").alias("external_id"),
        name.alias("filename"),
        "path",
        *(["content"] if content else []),
    )
    if limit is not None:
        out = out.orderBy("path").limit(limit)
    if out.select("path").isEmpty():
        raise FileNotFoundError(f"no image below {folder}")
    return out


def load_styles(spark: SparkSession, path: str) -> DataFrame:
    """(external_id, type, color) of a style table."""
    rows = spark.read.csv(path, header=True, mode="PERMISSIVE")
    return rows.select(
        F.col("id").cast("string").alias("external_id"), F.col("articleType").alias("type"), F.col("baseColour").alias("color")
    ).where(F.col("external_id").isNotNull())


def base_track(filename: Column) -> Column:
    """Name of the track of a window: ``genre.00012.3.wav`` gives ``genre.00012.wav``, other names stay."""
    return F.regexp_replace(filename, r"^(.*\.\d+)\.\d+(\.[^.]+)$", "$1$2")


def audio_windows(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """(filename, track, label, ordinal, features): one row per window with all features valid.

    Rows with a missing, unparsable or NaN value are dropped; a missing column drops every row.  A
    missing label column gives ``unknown``.
    """
    present = {c.lower(): c for c in reversed(df.columns)}
    values = [
        F.expr(f"try_cast(`{present[f.lower()]}` as float)") if f.lower() in present else F.lit(None).cast("float")
        for f in features
    ]
    label = F.col(f"`{present['label']}`") if "label" in present else F.lit("unknown")
    ordinal = F.col(f"`{present['ordinal']}`") if "ordinal" in present else F.col("filename")
    rows = df.select(
        F.col("filename"),
        base_track(F.col("filename")).alias("track"),
        label.alias("label"),
        ordinal.alias("ordinal"),
        F.array(*values).alias("features"),
    )
    return rows.where(~F.exists("features", lambda x: x.isNull() | F.isnan(x)))


def tracks(windows: DataFrame, limit: int | None = None) -> DataFrame:
    """(track, label, n_windows, features) with the windows in order; raises when there is no track."""
    packed = F.array_sort(F.collect_list(F.struct("ordinal", "filename", "features")))
    out = windows.groupBy("track").agg(
        F.min_by("label", F.struct("ordinal", "filename")).alias("label"),
        F.count(F.lit(1)).alias("n_windows"),
        packed.alias("_w"),
    )
    out = out.select("track", "label", "n_windows", F.col("_w.features").alias("features"))
    if limit is not None:
        out = out.orderBy("track").limit(limit)
    if out.isEmpty():
        raise ValueError("no track has a valid window")
    return out


def load_audio_features(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Tracks of a CSV of window features; ``limit`` counts tracks."""
    return tracks(audio_windows(spark.read.csv(path, header=True)), limit)
