"""Quality and timing of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall(reference: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """(query_id, recall): share of each query's reference ids that were found; 0 for an empty reference."""
    a = reference.groupBy("query_id").agg(F.collect_set(id_col).alias("_a"))
    b = found.groupBy("query_id").agg(F.collect_set(id_col).alias("_b"))
    both = a.join(b, "query_id", "full_outer")
    share = F.size(F.array_intersect("_a", "_b")) / F.size("_a")
    return both.select("query_id", F.coalesce(F.when(F.size("_a") > 0, share), F.lit(0.0)).alias("recall"))


def coherence(neighbours: DataFrame, labels: DataFrame, id_col: str, label_col: str = "label") -> DataFrame:
    """(label, coherence, n): mean share of a query's neighbours that have its label; queries without one are skipped."""
    own = labels.where(F.length(F.col(label_col).cast("string")) > 0)
    rows = neighbours.join(own.select(F.col(id_col).alias("query_id"), F.col(label_col).alias("_own")), "query_id")
    rows = rows.join(labels.select(id_col, F.col(label_col).alias("_its")), id_col, "left")
    per = rows.groupBy("query_id", "_own").agg(F.avg(F.coalesce((F.col("_own") == F.col("_its")).cast("double"), F.lit(0.0))).alias("c"))
    return per.groupBy(F.col("_own").alias("label")).agg(F.avg("c").alias("coherence"), F.count(F.lit(1)).alias("n"))


def chance(labels: DataFrame, label_col: str = "label") -> DataFrame:
    """(chance, uniform): sum of squared label shares, and 1 / number of labels."""
    counts = labels.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    return counts.agg((F.sum(F.col("n") * F.col("n")) / (total * total)).alias("chance"), (1 / F.count(F.lit(1))).alias("uniform"))


def order_statistics(df: DataFrame, group_cols: list[str], value: Column, digits: int = 6) -> DataFrame:
    """(group..., n, mean, p50, p95, per_second) with p50 = s[n // 2] and p95 = s[min(n - 1, int(0.95 n))].

    Elements of the sorted values, not interpolated.  Distinct values are counted, split into ranges of (group, value), and
    numbered within each range, which the sums of the ranges before shift: no group is one task.
    """
    from pyspark.sql import Window as W

    from kelpline.runtime import materialize, range_partitions

    rows = df.select(*group_cols, value.cast("double").alias("_v")).where("_v is not null")
    counted = rows.groupBy(*group_cols, "_v").agg(F.count(F.lit(1)).alias("_c"))  # one row per distinct value
    ranged = counted.repartitionByRange(range_partitions(df.sparkSession), *group_cols, "_v").withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    sums = ranged.groupBy(*group_cols, "_part").agg(F.sum("_c").alias("_s"))  # one row per group and range
    before = W.partitionBy(*group_cols).orderBy("_part")
    sums = sums.withColumn("_before", F.sum("_s").over(before.rowsBetween(W.unboundedPreceding, 0)) - F.col("_s"))
    sums = sums.withColumn("_n", F.sum("_s").over(W.partitionBy(*group_cols))).drop("_s")
    up_to = W.partitionBy(*group_cols, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    placed = ranged.withColumn("_in", F.sum("_c").over(up_to))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group_cols]
    placed = placed.alias("a").join(sums.alias("b"), [*same, F.col("a._part") == F.col("b._part")])
    placed = placed.select(*[F.col(f"a.{c}") for c in group_cols], "_v", "_c", (F.col("_before") + F.col("_in")).alias("_hi"), "_n")
    holds = lambda at: (F.col("_hi") > at) & (F.col("_hi") - F.col("_c") <= at)
    p50, p95 = F.floor(F.col("_n") / 2), F.least(F.col("_n") - 1, F.floor(F.col("_n") * 0.95))
    out = placed.groupBy(*group_cols).agg(
        F.sum("_c").alias("n"),
        (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"),
        F.max(F.when(holds(p50), F.col("_v"))).alias("p50"),
        F.max(F.when(holds(p95), F.col("_v"))).alias("p95"),
    )
    return out.select(*group_cols, "n", F.round("mean", digits).alias("mean"), "p50", "p95", F.round(1000 / F.col("mean"), digits).alias("per_second"))


def recycled(base: DataFrame, order: list[str], n: int, id_col: str = "external_id") -> DataFrame:
    """``n`` rows: the base again and again under new ids ``id-i``; the first ``n`` rows if it has as many."""
    from kelpline.sources.songs import dense_ids

    numbered = dense_ids(base, order, "_row")
    m = numbered.count()
    if m >= n or m == 0:
        return numbered.where(F.col("_row") < n).drop("_row")
    times = base.sparkSession.range(n).select("id", F.pmod("id", F.lit(m)).alias("_row"))
    again = times.join(numbered, "_row")
    return again.withColumn(id_col, F.concat(F.col(id_col).cast("string"), F.lit("-"), F.col("id").cast("string"))).drop("_row", "id")


def generated_queries(codebook: DataFrame, n: int, terms: int = 3, top: int = 200, seed: int = 0) -> DataFrame:
    """(query_id, text): ``n`` queries of ``terms`` random words among the ``top`` most frequent ones."""
    from pyspark.sql import Window as W

    words = [r["term"] for r in codebook.where(F.col("word_idx") < top).select("term").collect()]  # at most ``top``
    drawn = codebook.sparkSession.range(n).toDF("query_id").select("query_id", F.explode(F.lit(words)).alias("term"))
    order = W.partitionBy("query_id").orderBy(F.xxhash64(F.lit(seed), "query_id", "term"), "term")
    picked = drawn.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= terms)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "term"))), lambda x: x["term"]), " ")
    return picked.groupBy("query_id").agg(text.alias("text"))


def write_csv(df: DataFrame, path: str) -> None:
    """A table of results as one CSV file with a header below ``path``; for reports of few rows."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')
