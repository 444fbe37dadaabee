"""Frequencies of all terms of a collection, kept by signed changes.

A record that is added contributes +1 for every occurrence, a deleted one -1, and a changed one both.
Only the records of a batch are read; their changes are summed by term before and after the shuffle
and appended to a partitioned table.  The counts of a term are the sum of its changes; ``compact``
folds the batches into one.

What counts is named by a manifest, written last and under a new number, so a batch or a compaction that
stops half-way leaves the counts as they were; its folder is not read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm.common import check_columns, clean_term, grouped_per_id, latest_per_id, terms_of
from kelpline.runtime import new_path, range_partitions

#: The row of a batch that holds the change of the number of records; no term is empty.
TOTAL = ""


def record_changes(
    before: DataFrame | None, after: DataFrame | None, id_col: str, text_col: str, order: list[str] | None = None
) -> DataFrame:
    """(id, old_text, new_text) of the records that were added, changed or deleted between two states.

    Records with a null text or id do not exist.  Of repeated ids the greatest (``order``, text) counts.
    """
    state = before if before is not None else after
    # two states meet by id, so their rows are spread by it anyway
    per_id = latest_per_id if before is None or after is None else grouped_per_id
    if state is None:
        raise ValueError("there is neither a state before nor one after")

    def clean(df: DataFrame | None, name: str) -> DataFrame:
        if df is None:
            df = state.limit(0)
        check_columns(df, id_col, text_col)
        cols = [id_col, text_col, *[c for c in order or [] if c not in (id_col, text_col)]]
        rows = per_id(df.select(*cols), id_col, [text_col], order).where(F.col(text_col).isNotNull())
        return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias(name))

    if before is None:
        return clean(after, "new_text").select("id", F.lit(None).cast("string").alias("old_text"), "new_text")
    if after is None:
        return clean(before, "old_text").select("id", "old_text", F.lit(None).cast("string").alias("new_text"))
    both = clean(before, "old_text").join(clean(after, "new_text"), "id", "full_outer")
    return both.where(~F.col("old_text").eqNullSafe(F.col("new_text"))).select("id", "old_text", "new_text")


def signed_deltas(changes: DataFrame) -> DataFrame:
    """(term, occurrences, records): the changes of every term that ``changes`` touch; zero rows vanish."""

    def signed(text: Column, sign: int) -> Column:
        found = terms_of(text)
        every = F.transform(found, lambda t: F.struct(t.alias("term"), F.lit(sign).alias("o"), F.lit(0).alias("r")))
        once = F.transform(
            F.array_distinct(found), lambda t: F.struct(t.alias("term"), F.lit(0).alias("o"), F.lit(sign).alias("r"))
        )
        total = F.array(F.struct(F.lit(TOTAL).alias("term"), F.lit(0).alias("o"), F.lit(sign).alias("r")))
        return F.when(text.isNotNull(), F.concat(every, once, total)).otherwise(F.slice(total, 1, 0))

    rows = changes.select(F.explode(F.concat(signed(F.col("old_text"), -1), signed(F.col("new_text"), 1))).alias("c"))
    summed = rows.groupBy(F.col("c.term").alias("term")).agg(
        F.sum("c.o").alias("occurrences"), F.sum("c.r").alias("records")
    )
    return summed.where((F.col("occurrences") != 0) | (F.col("records") != 0))


class TermCounts:
    """Persistent counts in ``path``: one folder per batch, partitioned by a hash of the term.

    ``buckets``, the number of partitions, is fixed when the store is made; by default as many as shuffles have.
    There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or new_path(spark, "term-counts")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._state = {"number": 0, "buckets": buckets or range_partitions(spark), "folders": [], "batches": []}
        numbers = self._manifests()
        if numbers:
            lines = spark.read.text(f"{self.path}/manifest-{numbers[-1]}.json").collect()  # one short file
            self._state = json.loads("\n".join(r["value"] for r in lines))

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _manifests(self) -> list[int]:
        if not self._fs.exists(self._at("")):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at(""))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _write(self, rows: DataFrame) -> str:
        """A new folder that nothing names yet."""
        folder, buckets = f"changes-{uuid.uuid4().hex[:12]}", self._state["buckets"]
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        rows.withColumn("bucket", bucket).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return folder

    def _publish(self, folders: list[str], batches: list[str]) -> None:
        told = self._state | {"number": self._state["number"] + 1, "folders": folders, "batches": batches}
        final = self._at(f"manifest-{told['number']}.json")
        draft = self._at(f"draft-{uuid.uuid4().hex[:12]}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        if not self._fs.rename(draft, final):
            raise RuntimeError(f"another writer has published {final}")
        self._state = told
        for n in self._manifests():
            if n < told["number"]:
                self._fs.delete(self._at(f"manifest-{n}.json"), False)

    def apply(self, changes: DataFrame, batch: str | None = None) -> None:
        """Add a batch of changes.  A batch whose name was applied before changes nothing."""
        if batch is not None and batch in self._state["batches"]:
            return
        folder = self._write(signed_deltas(changes))
        self._publish([*self._state["folders"], folder], [*self._state["batches"], *([batch] if batch is not None else [])])

    def counts(self) -> DataFrame:
        """(term, occurrences, records) of every term that occurs."""
        return self._summed().where((F.col("term") != TOTAL) & (F.col("records") > 0))

    def n_records(self) -> int:
        row = self._summed().where(F.col("term") == TOTAL).agg(F.sum("records").alias("n")).first()
        return int(row["n"] or 0)

    def _summed(self) -> DataFrame:
        schema = "term string, occurrences long, records long"
        if not self._state["folders"]:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[f"{self.path}/{f}" for f in self._state["folders"]])
        return rows.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))

    def compact(self) -> None:
        """Fold all batches into one folder; folders that the new manifest does not name are removed after it is written."""
        folder = self._write(self._summed().where((F.col("occurrences") != 0) | (F.col("records") != 0)))
        self._publish([folder], self._state["batches"])
        for x in self._fs.listStatus(self._at("")):
            if x.getPath().getName().startswith("changes-") and x.getPath().getName() != folder:
                self._fs.delete(x.getPath(), True)


def marked_terms(
    store: TermCounts, codebook: DataFrame | None = None, term_col: str = "term", rare_below: int = 3, common_share: float = 0.2
) -> DataFrame:
    """(term, occurrences, records, mark) of every stored and every codebook term.

    mark is ``rare`` below ``rare_below`` records, ``common`` in more than ``common_share`` of all
    records, else ``useful``.  Codebook terms that no record holds come out with zeros, as rare.
    Null and blank codebook terms are dropped.  An empty collection marks every codebook term rare.
    """
    counts = store.counts()
    if codebook is not None:
        wanted = codebook.select(clean_term(F.col(term_col)).alias("term")).where(F.length("term") > 0)
        zeros = wanted.select("term", F.lit(0).cast("long").alias("occurrences"), F.lit(0).cast("long").alias("records"))
        counts = counts.unionByName(zeros).groupBy("term").agg(
            F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")
        )
    limit = common_share * store.n_records()
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > limit, "common").otherwise("useful")
    return counts.withColumn("mark", mark)
