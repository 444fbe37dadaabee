"""Planted clusters of descriptors through codebook, index and search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.engine import Engine
from kelpline.functions import vectors as vx
from kelpline.operators import codebook as cb
from kelpline.operators import knn
from kelpline.operators.index import build_vector_index
from kelpline.plans.planner import NotFound


def planted(spark, n=15, seed=42):
    rng = np.random.default_rng(seed)
    centres = 10 * np.eye(8)[:3]
    rows = [
        (i, f"item-{i}", str(i % 3), (centres[i % 3] + rng.normal(0, 0.5, (40, 8))).tolist(), (np.ones(32) / 32).tolist())
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "item_id long, filename string, label string, descriptors array<array<double>>, colour array<double>"
    )


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.build("ecommerce", "image", planted(spark).drop("colour"), k=3)
    return e


def test_codebook_shape(engine):
    rows = engine.index("image").codebook.collect()
    assert len(rows) == 3 and all(len(r["vec"]) == 8 for r in rows)


def test_fresh_descriptors_find_their_cluster(engine):
    rng = np.random.default_rng(7)
    for c in range(3):
        asked = (10 * np.eye(8)[c] + rng.normal(0, 0.5, (30, 8))).tolist()
        best = engine.search_descriptors("image", asked, 1).first()
        assert best["label"] == str(c) and best["score"] > 0.9


def test_neighbours_of_a_stored_item(engine):
    found = engine.search_like("image", "filename", "item-0", 4).collect()
    assert {r["label"] for r in found} == {"0"} and "item-0" not in {r["filename"] for r in found}
    told = engine.run("SELECT filename FROM products WHERE filename = 'item-0' LIMIT 2")
    assert told["count"] == 2
    with pytest.raises(NotFound):
        engine.run("SELECT * FROM products WHERE filename = 'nothing'")
    with pytest.raises(ValueError):
        engine.search_descriptors("image", [])


def test_colours_extend_the_histogram(spark):
    ix = build_vector_index(planted(spark), "image", 3, "descriptors", "colour")
    assert ix.hist_dim == 3 + 32
    alone = build_vector_index(planted(spark), "image", 3, "descriptors", "colour", alpha=0)
    assert alone.hist_dim == 3


def test_sample_and_totals(engine):
    total, rows = engine.sample_items("image", "1", 3)
    assert total == 5 and rows.count() == 3


def test_no_descriptors(spark):
    with pytest.raises(ValueError):
        build_vector_index(planted(spark).where("false"), "image", 3)


def test_lloyd_lowers_the_distance(spark):
    rows = planted(spark).select("item_id", F.posexplode("descriptors").alias("pos", "vec"))
    start = cb.descriptor_sample(rows, ["item_id", "pos"], 3)
    start = start.select((F.row_number().over(__import__("pyspark").sql.Window.orderBy("item_id", "pos")) - 1).alias("word_idx"), "vec")

    def inertia(centroids):
        placed = cb.assign(rows, centroids).join(centroids.withColumnRenamed("vec", "c"), "word_idx")
        apart = F.zip_with("vec", "c", lambda a, b: a - b)
        return placed.agg(F.sum(vx.dot(apart, apart))).first()[0]

    values = [inertia(cb.lloyd(rows, start, n)) for n in (0, 1, 3)]
    assert values[0] >= values[1] >= values[2]


def test_ties_go_to_the_lowest_word(spark):
    rows = spark.createDataFrame([([0.0, 1.0],)], "vec array<double>")
    words = spark.createDataFrame([(4, [0.0, 2.0]), (1, [0.0, 2.0])], "word_idx int, vec array<double>")
    assert cb.assign(rows, words).first()["word_idx"] == 1
    with pytest.raises(cb.EmptyCodebook):
        cb.assign(rows, words.where("false"))


def test_scaler_of_a_constant_dimension(spark):
    rows = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "vec array<double>")
    fitted = {r["dim"]: (r["mean"], r["scale"]) for r in cb.z_fit(rows).collect()}
    assert fitted == {0: (2.0, 1.0), 1: (5.0, 1.0)}


def test_exact_neighbours_leave_out_what_has_no_direction(spark):
    rows = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, 0.0]), (7, [1.0])],
        "id long, v array<double>",
    )
    asked = rows.select(F.col("id").alias("query_id"), "v")
    found = [(r["query_id"], r["id"]) for r in knn.exact(rows, asked, 2, "id", "v").orderBy("query_id", "place").collect()]
    assert found == [(1, 6), (1, 2), (2, 1), (2, 6), (6, 1), (6, 2)]
    assert knn.exact(rows.where("false"), asked, 2, "id", "v").count() == 0
    assert knn.by_example(rows, 99, 2, "id", "v").count() == 0


def test_index_of_cells(spark, tmp_path):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(20, 16))
    vecs = np.concatenate([base + rng.normal(0, 0.05, base.shape) for _ in range(6)])
    rows = spark.createDataFrame([*[(i, v.tolist()) for i, v in enumerate(vecs)], (900, None), (901, [0.0] * 16)], "id long, v array<double>")
    asked = rows.where("id < 20 OR id >= 900").select(F.col("id").alias("query_id"), "v")
    pairs = lambda df: {(r[0], r[1]) for r in df.select("query_id", "id").collect()}
    want = pairs(knn.exact(rows, asked, 5, "id", "v"))
    path = f"file://{tmp_path}/cells"
    built = knn.build_cells(rows, "id", "v", path, n_cells=8)
    assert sum(r["n"] for r in built.sizes().collect()) == len(vecs)
    assert pairs(knn.search_cells(knn.load_cells(spark, path), asked, 5, 8, "v")) == want
    shallow = knn.search_cells(built, asked, 5, 2, "v")
    assert len(want & pairs(shallow)) / len(want) > 0.9
    assert knn.compared_share(built, asked, 2, "v").first()["share"] < 0.6
    assert knn.search_cells(built, asked.where("false"), 5, 2, "v").count() == 0
    with pytest.raises(ValueError):
        knn.build_cells(rows.where("id >= 900"), "id", "v", path)
    knn.drop_cells(built)
    assert not (tmp_path / "cells").exists()


def test_nearest_keeps_ties_by_id():
    near = knn._Nearest(2, 6)
    near.add(np.array([[0.5, 0.1, 0.5, np.inf]]), np.array([9, 4, 3, 1]), np.array([7]))
    near.add(np.array([[0.5]]), np.array([2]), np.array([7]))
    assert [x.tolist() for x in near.best()] == [[7, 7], [4, 2], [0.1, 0.5]]


def test_images_from_a_folder_and_from_bytes(spark, tmp_path):
    """With an extractor of our own: descriptors are the numbers a file holds."""
    rng = np.random.default_rng(3)
    centres = 10 * np.eye(8)[:3]
    data = {}
    for i in range(9):
        data[f"p{i}.png"] = (centres[i % 3] + rng.normal(0, 0.5, (40, 8))).astype(np.float32).tobytes()
        (tmp_path / f"p{i}.png").write_bytes(data[f"p{i}.png"])
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("no image")

    def describe(content):
        @F.pandas_udf("array<array<float>>")
        def numbers(data):
            return data.map(lambda d: np.frombuffer(bytes(d), np.float32).reshape(-1, 8).tolist())

        return numbers(content)

    engine = Engine(spark)
    engine.build_images(f"file://{tmp_path}", 3, alpha=0, describe=describe)
    assert engine.index("image").items.count() == 9
    best = engine.search_bytes("image", data["p4.png"], 3, describe)
    assert {r["filename"] for r in best.collect()} == {"p1.png", "p4.png", "p7.png"}
    with pytest.raises(ValueError):
        engine.search_bytes("image", b"", 3, describe)
    told = engine.compare_like("image", "external_id", "p0", 2)
    assert [t["method"] for t in told] == ["inverted", "dense"] and all({r["filename"] for r in t["results"]} == {"p3.png", "p6.png"} for t in told)
    with pytest.raises(NotFound):
        engine.compare_like("image", "external_id", "nothing")


def test_large_images_are_shrunk_by_areas():
    from kelpline.functions import images

    rgb = np.zeros((600, 1024, 3), np.uint8)
    rgb[:, 512:] = 200
    small = images.shrunk(rgb, 512)
    assert small.shape == (300, 512, 3) and small[:, :256].max() == 0 and small[:, 256:].min() == 200
    assert images.shrunk(rgb[:10, :10], 512) is not None and images.shrunk(rgb[:10, :10], 512).shape == (10, 10, 3)
    assert images.shrunk(np.full((3, 1000, 3), 7, np.uint8), 100).shape == (1, 100, 3)
