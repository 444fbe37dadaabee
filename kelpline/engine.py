"""One object for building, storing and asking indexes."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kelpline.functions import audio, images
from kelpline.functions.text import Analyzer, query_frame
from kelpline.operators import fulltext, knn, search
from kelpline.operators import histogram as hg
from kelpline.operators.extension import Extractor
from kelpline.operators.index import Index, build_text_index, build_vector_index
from kelpline.plans.language import parse
from kelpline.plans.planner import IndexNotBuilt, NotFound, plan
from kelpline.runtime import materialize
from kelpline.sources import media, songs, store

LARGEST_TOP = 50


@dataclass
class Engine:
    """Indexes by modality, in memory or loaded from ``path`` on first use."""

    spark: SparkSession
    path: str | None = None
    app: str = "default"
    indexes: dict[str, Index] = field(default_factory=dict)

    # -- building --

    def build_text(self, source: str | DataFrame, k: int = 256, limit: int | None = None, analyzer: Analyzer = Analyzer(stem=True)) -> Index:
        items = songs.load_songs(self.spark, source, limit) if isinstance(source, str) else source
        return self._keep(build_text_index(items, k, analyzer))

    def build_audio(self, source: str | DataFrame, k: int = 128, limit: int | None = None, **kw) -> Index:
        """From a CSV of window features, or rows (track, label, features)."""
        rows = media.load_audio_features(self.spark, source, limit) if isinstance(source, str) else source
        rows = songs.dense_ids(rows.withColumn("filename", F.col("track")), ["track"], "item_id")
        return self._keep(build_vector_index(rows, "audio", k, "features", **kw))

    def build_images(
        self, source: str | DataFrame, k: int = 256, alpha: float = 0.5, limit: int | None = None, describe: Extractor | None = None,
        colour_of: Extractor | None = None, **kw,
    ) -> Index:
        """From a folder, or rows (item_id, filename, external_id, descriptors[, colour]); items without descriptors are skipped.

        ``describe`` and ``colour_of`` take encoded images; by default local descriptors and colour histograms.
        """
        if isinstance(source, str):
            files = songs.dense_ids(media.scan_images(self.spark, source, limit), ["path"], "item_id")
            told = (describe or images.sift_descriptors)("content"), (colour_of or images.colour_histogram)("content")
            source = files.select("item_id", "filename", "external_id", told[0].alias("descriptors"), *([told[1].alias("colour")] if alpha > 0 else []))
            source = materialize(source, "described")
        rows = source.where(F.size("descriptors") > 0)
        colour = "colour" if "colour" in rows.columns else None
        return self._keep(build_vector_index(rows, "image", k, "descriptors", colour, alpha, **kw))

    def build(self, app: str, modality: str, source, **kw) -> Index:
        builders = {("music", "text"): self.build_text, ("music", "audio"): self.build_audio, ("ecommerce", "image"): self.build_images}
        if (app, modality) not in builders:
            raise NotImplementedError(f"there is no pipeline for {app} / {modality}")
        return builders[app, modality](source, **kw)

    def _keep(self, index: Index) -> Index:
        self.indexes[index.modality] = index
        return index

    def persist(self, modality: str) -> DataFrame:
        return store.save(self.index(modality), self.path, self.app)

    def index(self, modality: str) -> Index:
        if modality not in self.indexes:
            if self.path is None:
                raise IndexNotBuilt(f"there is no {modality} index")
            self.indexes[modality] = store.load(self.spark, self.path, modality, self.app)
        return self.indexes[modality]

    # -- asking --

    @staticmethod
    def _checked(n: int) -> int:
        if not 1 <= n <= LARGEST_TOP:
            raise ValueError(f"n must lie between 1 and {LARGEST_TOP}")
        return n

    def search_text(self, text: str, n: int = 10) -> DataFrame:
        return search.search_text_items(self.index("text"), query_frame(self.spark, text), self._checked(n))

    def search_descriptors(self, modality: str, descriptors: list[list[float]], n: int = 10, colour: list[float] | None = None, alpha: float = 0.5) -> DataFrame:
        """By raw descriptors; ValueError when there are none."""
        if not descriptors:
            raise ValueError("the query has no descriptors")
        row = [(0, [[float(x) for x in d] for d in descriptors], [float(x) for x in colour or []])]
        asked = self.spark.createDataFrame(row, "query_id long, descriptors array<array<double>>, colour array<double>")
        index = self.index(modality)
        query = search.quantise_descriptors(index, asked, "descriptors", "colour" if colour else None, alpha)
        return search.search_histograms(index, query, self._checked(n))

    def search_bytes(self, modality: str, data: bytes, n: int = 10, describe: Extractor | None = None, colour_of: Extractor | None = None, alpha: float = 0.5) -> DataFrame:
        """By an encoded image or clip; ValueError when it is empty or nothing in it can be described."""
        if not data:
            raise ValueError("the query is empty")
        one = self.spark.createDataFrame([(bytearray(data),)], "content binary")
        usual = images.sift_descriptors if modality == "image" else audio.clip_features
        told = [(describe or usual)("content").alias("d")]
        if modality == "image" and self.index("image").colour_bins:
            told.append((colour_of or images.colour_histogram)("content").alias("c"))
        row = one.select(*told).first()
        return self.search_descriptors(modality, row["d"] or [], n, row["c"] if len(told) > 1 else None, alpha)

    def search_like(self, modality: str, key_col: str, key: str, n: int = 10) -> DataFrame:
        index = self.index(modality)
        if index.items.where(F.col(key_col).cast("string") == str(key)).isEmpty():
            raise NotFound(f"there is no {modality} item {key!r}")
        return search.search_like(index, key_col, key, self._checked(n))

    def sql(self, text: str) -> DataFrame:
        query = parse(text)
        return plan(query, {query.modality: self.index(query.modality)})

    def run(self, text: str) -> dict:
        """{parsed, count, results} of a query of the language."""
        query = parse(text)
        rows = [r.asDict() for r in self.sql(text).collect()]  # at most the query's limit
        return {"parsed": vars(query), "count": len(rows), "results": rows}

    def sample_items(self, modality: str, label: str | None = None, n: int = 10, seed: int = 0) -> tuple[int, DataFrame]:
        """(number of items of the label, whatever its case; ``n`` random ones)."""
        items = self.index(modality).items
        if label is not None:
            items = items.where(F.lower("label") == label.lower())
        return items.count(), items.orderBy(F.rand(seed)).limit(n)

    def compare_like(self, modality: str, key_col: str, key: str, n: int = 10) -> list[dict]:
        """Items like a stored one by postings and by exact dense vectors: [{method, latency_ms, count, results}]."""
        index = self.index(modality)
        first = index.items.where(F.col(key_col).cast("string") == str(key)).select("item_id").first()
        if first is None:
            raise NotFound(f"there is no {modality} item {key!r}")
        dense = hg.dense_of_sparse(index.postings, "chunk_id", index.hist_dim).join(index.chunks.select("chunk_id", "item_id"), "chunk_id")
        dense = materialize(dense, "dense")

        def exact() -> DataFrame:
            near = knn.by_example(dense, first["item_id"], n, "item_id", "hist")
            near = near.select("item_id", F.round(1 - F.col("dist"), 4).alias("score"), F.row_number().over(W.orderBy(F.round("dist", 6), "item_id")).alias("place"))
            return near.join(index.items, "item_id")

        return [self._timed("inverted", lambda: self.search_like(modality, key_col, key, n)), self._timed("dense", exact)]

    @staticmethod
    def _timed(name: str, method) -> dict:
        began = time.perf_counter()
        rows = [r.asDict() for r in method().orderBy("place").collect()]  # at most n
        return {"method": name, "latency_ms": round((time.perf_counter() - began) * 1000, 3), "count": len(rows), "results": rows}

    def compare(self, text: str, n: int = 10) -> list[dict]:
        """The same text by postings, boolean full text and exact dense vectors: [{method, latency_ms, count, results}]."""
        index, asked = self.index("text"), query_frame(self.spark, text)

        def own() -> DataFrame:
            return search.search_text_items(index, asked, n)

        def boolean() -> DataFrame:
            postings = fulltext.term_postings(index.chunks, "content", index.analyzer, "chunk_id")
            return fulltext.best_items(fulltext.match_all(postings, asked, index.analyzer), index.chunks, n)

        def dense() -> DataFrame:
            return knn.dense_items(index, search.quantise_text(index, asked), n)

        return [self._timed(name, method) for name, method in (("inverted", own), ("full_text", boolean), ("dense", dense))]
