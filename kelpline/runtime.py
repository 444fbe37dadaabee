"""Session settings and durable intermediate tables.

Iterative operators cut their lineage with :func:`materialize`, which writes a Parquet table into the
folder that every executor shares (``spark.checkpoint.dir``), so a lost executor costs a re-read and
nothing more.  Only where that setting is absent and the master is a single local JVM (as in tests)
is a folder of the machine used.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []


def build_session(app: str = "kelpline", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by all executors; on a cluster without ``spark.checkpoint.dir`` this raises."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    existing = spark.sparkContext._jsc.sc().getCheckpointDir()
    if existing.isDefined():
        return existing.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIR:
        holder = tempfile.TemporaryDirectory(prefix="kelpline-")
        atexit.register(holder.cleanup)
        _OWN_DIR.append("file://" + holder.name)
    return _OWN_DIR[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "step", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and read it back: the plan behind it is not run again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kelpline_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete a table of :func:`materialize` that nothing will read again."""
    path = getattr(df, "_kelpline_path", None)
    if path is None:
        return
    spark = df.sparkSession
    with contextlib.suppress(Exception):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def range_partitions(spark: SparkSession) -> int:
    """Partitions for data that is sorted into ranges and kept: as many as shuffles have, or cores if more.

    A stated number is not merged by adaptive execution, so what reads the ranges runs in parallel.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")
