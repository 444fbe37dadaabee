"""Stems, colours, metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.functions.images import colour_histogram, decode_rgb, hsv_histogram, hsv_of_rgb, scaled_size
from kelpline.functions.stemmer import stem_spanish
from kelpline.operators import metrics


@pytest.mark.parametrize(
    "word, stem",
    [
        ("canciones", "cancion"),
        ("cantando", "cant"),
        ("corazones", "corazon"),
        ("rápidamente", "rapid"),
        ("felicidad", "felic"),
        ("nacionalidad", "nacional"),
        ("habitaciones", "habit"),
        ("dándole", "dandol"),
        ("comprándolo", "compr"),
        ("chicas", "chic"),
        ("biología", "biolog"),
        ("existencia", "existent"),
        ("llegaron", "lleg"),
        ("sigue", "sig"),
        ("a", "a"),
        ("", ""),
        ("lights", "lights"),
    ],
)
def test_stems(word, stem):
    assert stem_spanish(word) == stem


def test_colours():
    red = hsv_of_rgb(np.full((2, 2, 3), [255, 0, 0]))
    assert red.tolist() == [[0.0, 255.0, 255.0]] * 4
    hist = hsv_histogram(red)
    assert len(hist) == 32 and np.linalg.norm(hist) == pytest.approx(1) and (hist > 0).sum() == 3
    grey = hsv_histogram(hsv_of_rgb(np.full((2, 2, 3), 128)))
    assert grey[:16].sum() == 0  # no hue without saturation
    assert hsv_histogram(np.zeros((0, 3))).sum() == 0
    assert scaled_size(100, 1000) == (51, 512) and scaled_size(10, 20) == (256, 512)
    assert scaled_size(10, 20, enlarge=False) == (10, 20)
    with pytest.raises(ValueError):
        decode_rgb(b"")


def test_undecodable_images_are_null(spark):
    try:
        import PIL  # noqa: F401
    except ImportError:
        pytest.skip("no decoder")
    df = spark.createDataFrame([(bytearray(b"no image"),)], "content binary")
    assert df.select(colour_histogram(F.col("content"))).first()[0] is None


def test_order_statistics(spark):
    df = spark.createDataFrame([("a", float(x)) for x in [5, 1, 1, 9, 7, 3, 3, 2, 8, 4]] + [("b", 2.0), ("b", None)], "g string, v double")
    rows = {r["g"]: r for r in metrics.order_statistics(df, ["g"], F.col("v")).collect()}
    s = sorted([5, 1, 1, 9, 7, 3, 3, 2, 8, 4])
    assert (rows["a"]["p50"], rows["a"]["p95"], rows["a"]["n"]) == (s[5], s[9], 10)
    assert (rows["b"]["p50"], rows["b"]["p95"]) == (2.0, 2.0)


def test_recall_and_coherence(spark):
    a = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "query_id long, id long")
    b = spark.createDataFrame([(1, 11), (1, 12), (3, 1)], "query_id long, id long")
    assert {r["query_id"]: r["recall"] for r in metrics.recall(a, b, "id").collect()} == {1: 0.5, 2: 0.0, 3: 0.0}
    labels = spark.createDataFrame([(1, "x"), (2, ""), (10, "x"), (11, "y")], "id long, label string")
    told = metrics.coherence(a, labels, "id").collect()
    assert [(r["label"], r["coherence"], r["n"]) for r in told] == [("x", 0.5, 1)]


def test_recycled_is_a_prefix_or_longer(spark):
    base = spark.createDataFrame([(i, f"e{i}") for i in range(5)], "k long, external_id string")
    assert metrics.recycled(base, ["k"], 3).count() == 3
    rows = metrics.recycled(base, ["k"], 12).collect()
    assert len(rows) == 12 and len({r["external_id"] for r in rows}) == 12
