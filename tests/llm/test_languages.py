import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.llm import languages as lg


@pytest.fixture(scope="module")
def model(spark, data):
    ex = spark.read.parquet(f"{data}/lang_examples.parquet")
    return lg.fit_languages(ex, "content", "lang")


def test_held_out_accuracy(spark, data):
    rows = spark.read.parquet(f"{data}/lang_examples.parquet").toPandas()
    held = rows.example_id % 4 == 0
    fitted = lg.train(*lg.training_rows(list(rows[~held].content), list(rows[~held].lang)))
    texts, labels = list(rows[held].content.map(lambda t: lg.line_words(t.split("\n")[0]) or "")), list(rows[held].lang)
    found = fitted.log_probabilities(texts)
    right = np.array([lg.LANGUAGES[i] for i in found.argmax(1)]) == np.array(labels)
    assert right.mean() >= 0.97
    assert np.exp(found).sum(1) == pytest.approx(1.0)
    assert (fitted.weight == 0).mean() > 0.5  # the l1 penalty makes it sparse


@pytest.mark.parametrize("line", ["", "   ", "[Chorus]", "[Verse 2: A]", "(x2)", "Coro:", "la la la", "Oh, oh, oh!", "123 456", "na na na na na"])
def test_lines_without_a_language(line):
    assert lg.line_words(line) is None


def test_labels(spark):
    rows = [("en", "en"), ("EN", "en"), ("en-US", "en"), ("en_GB", "en"), ("English", "en"), (" español ", "es"), ("pt-BR", "pt"),
            ("deu", "de"), ("русский", "ru"), ("??", None), ("", None), (None, None), ("unknown", None), ("und", None), ("nl", None)]
    df = spark.createDataFrame(rows, "label string, want string").withColumn("got", lg.language_of_label(F.col("label")))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_path_ignores_doubt_but_not_evidence():
    log_p = np.log(np.array([[0.98, 0.02], [0.45, 0.55], [0.97, 0.03], [1e-6, 1 - 1e-6]]))
    assert lg.best_path(log_p, 1.5).tolist() == [0, 0, 0, 1]


SONG = "the lantern burns slowly over the rooftops\n\n[Coro]\nla la la\nthe morning rain follows the hungry tide\nel puerto callado guarda la luna de cobre\nuna brújula rota vuelve otra vez"


def test_stretches_and_states(spark, model):
    rows = [
        (1, SONG, "en"), (2, SONG, None), (3, "el hilo de plata nunca duerme junto al molino viejo", "fr"),
        (4, "the red umbrella waits for me behind the market", "English"), (5, None, None), (6, "", ""), (7, "[Intro]\nla la la", None),
        (4, "the red umbrella waits for me behind the market", "English"), (None, SONG, None),
        (8, "der silberne Faden schläft nie unter der Brücke\n" * 3000, "de"),
    ]
    df = spark.createDataFrame(rows, "id long, words string, tag string").withColumn("lang", F.lit("clash"))
    out = lg.judged_languages(df, "id", "words", "tag", model).toPandas()
    got = {(r.id, r.first_line, r.lang, r.label_state) for r in out.itertuples()}
    assert got == {
        (1, 0, "en", "mixed"), (1, 5, "es", "mixed"), (2, 0, "en", "missing"), (2, 5, "es", "missing"),
        (3, 0, "es", "wrong"), (4, 0, "en", "right"), (8, 0, "de", "right"),
    }
    assert out.confidence.between(0, 1).all()
    assert int(out[out.id == 8].n_lines.iloc[0]) == 3000
    assert lg.language_stretches(df.where("false"), "id", "words", model).count() == 0


def test_no_examples(spark):
    empty = spark.createDataFrame([], "content string, lang string")
    with pytest.raises(ValueError):
        lg.fit_languages(empty, "content", "lang")
