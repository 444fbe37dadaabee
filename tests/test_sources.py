"""Files in, ids and names, streams."""

import json

import pytest
from pyspark.sql import functions as F

from kelpline.functions.audio import FEATURES, window_bounds
from kelpline.functions.text import Analyzer
from kelpline.operators.index import build_text_index
from kelpline.sources import media, songs
from kelpline.functions.text import query_frame
from kelpline.operators.search import search_text_items
from kelpline.streaming.append import append_stream, grown_index

ROWS = [
    {"Link": "x1", "song": "One", "artists": "A", "text": "first line\nsecond\n\nthird, \"quoted\""},
    {"Link": "", "song": None, "artists": "B", "text": "solo"},
    {"Link": "0", "song": "Three", "artists": None, "text": None},
]


@pytest.fixture
def files(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(ROWS))
    df = spark.createDataFrame([tuple(r.values()) for r in ROWS], "Link string, song string, artists string, text string")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/s.parquet")
    df.coalesce(1).write.csv(f"file://{tmp_path}/s.csv", header=True, escape='"', quote='"')
    return tmp_path


@pytest.mark.parametrize("ending", ["json", "parquet", "csv"])
def test_songs(spark, files, ending):
    rows = {r["artist"] or "-": r for r in songs.load_songs(spark, f"file://{files}/s.{ending}").collect()}
    assert rows["A"]["external_id"] == "x1" and rows["A"]["lyrics"] == ROWS[0]["text"]
    assert sorted(r["item_id"] for r in rows.values()) == [0, 1, 2]
    assert rows["B"]["external_id"] == str(rows["B"]["item_id"])
    assert rows["-"]["external_id"] == str(rows["-"]["item_id"])


def test_limit_and_endings(spark, files):
    assert songs.load_songs(spark, f"file://{files}/s.json", limit=2).count() == 2
    with pytest.raises(ValueError):
        songs.load_songs(spark, "file:///nothing.xml")


def test_a_present_alias_wins_even_when_null(spark):
    df = spark.createDataFrame([(None, "b")], "Title string, name string")
    assert songs.map_columns(df).first()["title"] is None
    assert songs.map_columns(df).first()["lyrics"] is None


def test_dense_ids_of_nothing_and_of_ties(spark):
    empty = spark.createDataFrame([], "a long")
    assert songs.dense_ids(empty, ["a"]).count() == 0
    ties = spark.createDataFrame([(1,), (1,), (0,)], "a long")
    assert sorted(r["item_id"] for r in songs.dense_ids(ties, ["a"]).collect()) == [0, 1, 2]


@pytest.mark.parametrize(
    "name, want",
    [
        ("blues.00000.3.wav", "blues.00000.wav"),
        ("blues.00000.wav", "blues.00000.wav"),
        ("blues.wav", "blues.wav"),
        ("a.b.00001.12.wav", "a.b.00001.wav"),
    ],
)
def test_base_track(spark, name, want):
    assert spark.createDataFrame([(name,)], "f string").select(media.base_track(F.col("f"))).first()[0] == want


def test_audio_features(spark, tmp_path):
    def line(name, label, first):
        return ",".join([name, label, first, *["1.5"] * (len(FEATURES) - 1)])

    head = ",".join(["filename", "label", *FEATURES])
    lines = [head, line("r.00001.0.wav", "rock", "1"), line("r.00001.1.wav", "rock", "x"), line("r.00002.0.wav", "pop", ""), line("r.00001.2.wav", "rock", "3")]
    (tmp_path / "f.csv").write_text("\n".join(lines))
    rows = media.load_audio_features(spark, f"file://{tmp_path}/f.csv").collect()
    assert [(r["track"], r["label"], r["n_windows"]) for r in rows] == [("r.00001.wav", "rock", 2)]
    assert len(rows[0]["features"][0]) == 57
    short = spark.read.csv(f"file://{tmp_path}/f.csv", header=True).drop("tempo")
    with pytest.raises(ValueError):
        media.tracks(media.audio_windows(short))


@pytest.mark.parametrize(
    "samples, want",
    [(0, []), (10, [(0, 10)]), (30, [(0, 30)]), (34, [(0, 30)]), (36, [(0, 30), (30, 36)]), (90, [(0, 30), (30, 60), (60, 90)])],
)
def test_windows(spark, samples, want):
    df = spark.createDataFrame([(samples,)], "n long").select(window_bounds(F.col("n"), rate=10).alias("w"))
    assert [tuple(w) for w in df.first()["w"]] == want


def test_images(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.JPG", "sub/a.png", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    rows = media.scan_images(spark, f"file://{tmp_path}").orderBy("path").collect()
    assert [r["external_id"] for r in rows] == ["b", "a"]
    with pytest.raises(FileNotFoundError):
        media.scan_images(spark, f"file://{tmp_path}/sub", limit=0)


def test_stream(spark, tmp_path):
    items = spark.createDataFrame([(0, "red rain falls\n\nblue boats"), (1, "green rain")], "item_id long, lyrics string")
    ix = build_text_index(items, 10, Analyzer())
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    assert grown_index(ix, out) is ix
    for batch in ([(7, "green boats\n\nred rain"), (8, None)], [(9, "blue blue rain")]):
        spark.createDataFrame(batch, items.schema).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(items.schema).parquet(source)
        append_stream(arriving, ix, "item_id", "lyrics", out, f"file://{tmp_path}/ck").awaitTermination()
    grown = grown_index(ix, out)
    assert sorted(r["chunk_id"] for r in grown.chunks.collect()) == list(range(6))
    assert sorted(r["item_id"] for r in grown.items.collect()) == [0, 1, 7, 8, 9]
    found = search_text_items(grown, query_frame(spark, "blue"), 5).collect()
    assert {r["item_id"] for r in found} == {0, 9} and [r["content"] for r in found if r["item_id"] == 9] == ["blue blue rain"]
