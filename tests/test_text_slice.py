"""Songs to index to answers, on a small collection written for this test."""

import pytest
from pyspark.sql import functions as F

from kelpline.engine import Engine
from kelpline.functions.text import Analyzer
from kelpline.operators.split import paragraphs
from kelpline.plans.planner import IndexNotBuilt
from kelpline.sources import store

SONGS = [
    ("a1", "Fuego lento", "Norte", "El fuego lento quema la ciudad\nsin pasión ni prisa\n\nFuego que baila en la ciudad dormida"),
    ("a2", "Corazón de fuego", "Sur", "Mi corazón es de fuego\ny la pasión no duerme\n\nCorazón, corazón, vuelve a la calle"),
    ("a3", "Harbour lights", "East", "The harbour lights are burning low\n\nSmall boats are leaving in the night"),
    ("a4", "Paper robots", "West", "Robots made of paper dream\nelectric wires hum\n\nPaper robots never sleep"),
    ("a5", "Mar de invierno", "Norte", "El mar de invierno guarda barcos\n\nBarcos que nadie espera"),
    ("a6", "Night train", "East", "The night train leaves the city\n\nLights along the ocean road"),
    ("a7", "Lluvia", "Sur", "La lluvia cae sobre tejados viejos\n\nTejados y lluvia otra vez"),
    ("a8", "Garden gate", "West", "Behind the garden gate a song\n\nA song behind the wall"),
]


@pytest.fixture(scope="module")
def engine(spark):
    rows = spark.createDataFrame(SONGS, "external_id string, title string, artist string, lyrics string")
    items = rows.withColumn("item_id", F.regexp_extract("external_id", r"\d+", 0).cast("long") - 1)
    e = Engine(spark)
    e.build("music", "text", items.select("item_id", "external_id", "title", "artist", "lyrics"), k=128)
    return e


def titles(df):
    return [r["title"] for r in df.orderBy("place").collect()]


def test_sizes(engine):
    ix = engine.index("text")
    assert ix.items.count() == 8
    assert ix.chunks.count() == 16
    assert ix.n_terms() > 0 and ix.n_postings() > ix.n_terms() // 2


def test_weights_have_unit_length(engine):
    far = engine.index("text").norms.where(F.abs(F.col("norm") - 1) > 1e-9)
    assert far.count() == 0


def test_spanish_query(engine):
    assert {"Fuego lento", "Corazón de fuego"} <= set(titles(engine.search_text("fuego pasión ciudad", 3)))


def test_english_query(engine):
    found = engine.search_text("ocean city lights night", 3).orderBy("place").collect()
    assert found[0]["title"] == "Night train" and found[0]["score"] > 0


def test_best_item_and_its_chunk(engine):
    first = engine.search_text("electric wires robots", 1).first()
    assert first["title"] == "Paper robots" and "wires" in first["content"]


def test_unknown_words_find_nothing(engine):
    assert engine.search_text("zxqw wvyz", 5).count() == 0


def test_language_gives_the_same(engine):
    told = engine.run("SELECT title, nothing FROM songs WHERE lyrics ~ 'fuego pasión ciudad' LIMIT 3")
    assert told["count"] == len(told["results"]) and told["parsed"]["limit"] == 3
    assert set(told["results"][0]) == {"title", "score"}


def test_methods_agree(engine):
    told = {m["method"]: m for m in engine.compare("fuego", 3)}
    assert set(told) == {"inverted", "full_text", "dense"}
    for t in told.values():  # they rank by different measures, but all find both songs about fire
        assert {0, 1} <= {r["item_id"] for r in t["results"]}
    assert told["full_text"]["count"] == 2
    assert told["dense"]["count"] == 3  # items without the word fill up


def test_no_index(spark):
    with pytest.raises(IndexNotBuilt):
        Engine(spark).search_text("x")
    with pytest.raises(NotImplementedError):
        Engine(spark).build("music", "video", None)


def test_store_and_load(engine, spark, tmp_path):
    path = f"file://{tmp_path}"
    first = {r["table"]: r["rows"] for r in store.save(engine.index("text"), path, "music").collect()}
    again = {r["table"]: r["rows"] for r in store.save(engine.index("text"), path, "music").collect()}
    assert first == again and first["items"] == 8 and first["chunks"] == 16
    other = Engine(spark, path, "music")
    assert titles(other.search_text("fuego pasión ciudad", 3)) == titles(engine.search_text("fuego pasión ciudad", 3))
    assert store.load_histograms(spark, path, "text", "music").count() == first["histograms"]
    assert store.stored_bytes(spark, path) > 0
    store.drop(spark, path, "text", "music")
    with pytest.raises(IndexNotBuilt):
        store.load(spark, path, "text", "music")


@pytest.mark.parametrize(
    "text, want",
    [
        (None, []),
        ("", []),
        (" \n\t ", []),
        ("one", ["one"]),
        ("a\n\nb", ["a", "b"]),
        ("a\n \t\n\n b \n", ["a", "b"]),
        ("a\nb", ["a\nb"]),
    ],
)
def test_paragraphs(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(paragraphs(F.col("t")).alias("p")).first()["p"] == want


def test_short_parts_fall_back_to_the_whole(spark):
    df = spark.createDataFrame([("a\n\nb",)], "t string")
    assert df.select(paragraphs(F.col("t"), 5).alias("p")).first()["p"] == ["a\n\nb"]


def test_analyzer(spark):
    df = spark.createDataFrame([(1, "Las CANCIONES de Ñandú y los naïve x 42"), (2, None)], "id long, t string")
    plain = Analyzer(drop_stop=False, min_length=1)
    rows = {r["id"]: r["x"] for r in df.select("id", plain.tokens(F.col("t")).alias("x")).collect()}
    assert rows[1] == ["las", "canciones", "de", "ñandú", "y", "los", "na", "ve", "x", "42"] and rows[2] == []
    stems = [r["term"] for r in Analyzer(stem=True).exploded(df, "t", "id").orderBy("pos").collect()]
    assert stems == ["cancion", "ñandu", "na", "ve", "42"]
