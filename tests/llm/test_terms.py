import math

import pytest

from kelpline.llm import relevance as rv
from kelpline.llm import term_counts as tc

RECORDS = [
    (1, "Rojo rojo azul", 1), (2, "azul verde", 2), (3, "azul", 3), (4, None, 4), (5, "", 5), (6, "¡¿?!", 6),
    (2, "azul verde", 9), (None, "rojo", 1), (7, "gris " * 20000, 7),
]
BOOK = [(" Rojo ", 0), ("AZUL", 1), ("azul", 2), (None, 3), ("  ", 4), ("nunca", 5), ("gris", 6)]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(RECORDS, "chunk_id long, content string, df long")


@pytest.fixture(scope="module")
def book(spark):
    return spark.createDataFrame(BOOK, "term string, tf long")


def test_weights(records, book):
    out = {(r["chunk_id"], r["term"]): r for r in rv.term_relevance(records, "chunk_id", "content", book, order=["df"]).collect()}
    assert sorted(out) == [(1, "azul"), (1, "rojo"), (2, "azul"), (3, "azul"), (7, "gris")]
    r = out[1, "rojo"]
    assert (r["tf"], r["df"], r["n_records"], r["length"]) == (2, 1, 6, 3)
    assert r["log_weight"] == pytest.approx(math.log(3) * math.log10(6 / 1))
    mean = (3 + 2 + 1 + 0 + 0 + 20000) / 6
    want = math.log(1 + (6 - 1 + 0.5) / 1.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / mean))
    assert r["bm25"] == pytest.approx(want)


def test_all_terms_without_a_codebook(records):
    terms = {r["term"] for r in rv.term_relevance(records, "chunk_id", "content").collect()}
    assert terms == {"rojo", "azul", "verde", "gris"}


def test_best_terms_and_ties(spark):
    rows = spark.createDataFrame([(1, "b", 2.0), (1, "a", 2.0), (1, "c", 1.0), (2, "x", 0.0)], "id long, term string, log_weight double")
    best = rv.most_characteristic(rows, "id", "log_weight", k=None, tie=1e-9)
    assert sorted(r["term"] for r in best.collect()) == ["a", "b"]
    two = rv.most_characteristic(rows, "id", "log_weight", k=1).collect()
    assert [(r["id"], r["term"]) for r in two] == [(1, "a")]


def test_nothing(spark, records, book):
    assert rv.term_relevance(records.where("false"), "chunk_id", "content", book).count() == 0
    assert rv.term_relevance(records, "chunk_id", "content", book.where("false")).count() == 0
    with pytest.raises(ValueError):
        rv.term_relevance(records, "chunk_id", "text")


def counted(store):
    return {r["term"]: (r["occurrences"], r["records"]) for r in store.counts().collect()}


def test_changes_give_what_a_recount_gives(spark, tmp_path):
    old = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, "d"), (4, None)], "id long, t string")
    new = spark.createDataFrame([(1, "a b"), (3, "d"), (4, "b"), (5, "c c c")], "id long, t string")
    store = tc.TermCounts(spark, f"file://{tmp_path}/counts", buckets=3)
    store.apply(tc.record_changes(None, old, "id", "t"))
    assert counted(store) == {"a": (1, 1), "b": (3, 2), "c": (1, 1), "d": (1, 1)}
    changes = tc.record_changes(old, new, "id", "t")
    assert sorted(r["id"] for r in changes.collect()) == [1, 2, 4, 5]
    store.apply(changes)
    fresh = tc.TermCounts(spark, f"file://{tmp_path}/fresh")
    fresh.apply(tc.record_changes(None, new, "id", "t"))
    assert counted(store) == counted(fresh) and store.n_records() == fresh.n_records() == 4
    store.compact()
    assert counted(tc.TermCounts(spark, f"file://{tmp_path}/counts")) == counted(fresh)
    store.apply(tc.record_changes(new, None, "id", "t"))
    assert counted(store) == {} and store.n_records() == 0


def test_batches_count_once_and_stops_lose_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/counts"
    rows = spark.createDataFrame([(1, "a b b"), (2, "b c")], "id long, t string")
    store = tc.TermCounts(spark, path, buckets=2)
    for _ in range(2):  # the second time it is known
        store.apply(tc.record_changes(None, rows, "id", "t"), "monday")
    tc.TermCounts(spark, path).apply(tc.record_changes(None, rows, "id", "t"), "monday")
    more = spark.createDataFrame([(3, "c")], "id long, t string")
    store.apply(tc.record_changes(None, more, "id", "t"), "tuesday")
    want = {"a": (1, 1), "b": (3, 2), "c": (2, 2)}
    assert counted(store) == want and store.n_records() == 3

    def stop(*_):
        raise KeyboardInterrupt

    for step in ("_publish", "_write"):
        with monkeypatch.context() as m:
            m.setattr(tc.TermCounts, step, stop)
            with pytest.raises(KeyboardInterrupt):
                store.compact()
            with pytest.raises(KeyboardInterrupt):
                store.apply(tc.record_changes(None, more, "id", "t"), "wednesday")
        assert counted(store) == counted(tc.TermCounts(spark, path)) == want
    store.compact()
    again = tc.TermCounts(spark, path)
    assert counted(again) == want and len([x for x in (tmp_path / "counts").iterdir() if x.name.startswith("changes-")]) == 1
    again.apply(tc.record_changes(None, rows, "id", "t"), "monday")
    assert counted(again) == want


def test_marks(spark, book):
    rows = spark.createDataFrame([(i, "azul " + ("poco" if i < 3 else "") + (" rojo" if i < 2 else "")) for i in range(20)], "id long, t string")
    store = tc.TermCounts(spark)
    store.apply(tc.record_changes(None, rows, "id", "t"))
    marks = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in tc.marked_terms(store, book).collect()}
    assert marks == {
        "azul": (20, 20, "common"), "poco": (3, 3, "useful"), "rojo": (2, 2, "rare"), "nunca": (0, 0, "rare"), "gris": (0, 0, "rare"),
    }


def test_no_records(spark, book):
    store = tc.TermCounts(spark)
    assert {r["mark"] for r in tc.marked_terms(store, book).collect()} == {"rare"}
    with pytest.raises(ValueError):
        tc.record_changes(None, None, "id", "t")


@pytest.mark.parametrize("times", [[None, None], [None, "2024-01-01 00:00:00"]])
def test_chunks_without_a_time_are_counted(spark, tmp_path, times):
    from kelpline.llm.queries import _marked

    rows = [(i, "text", "moon moon", t) for i, t in enumerate(times)]
    chunks = spark.createDataFrame(rows, "chunk_id long, modality string, content string, loaded_at string")
    chunks.withColumn("loaded_at", chunks.loaded_at.cast("timestamp_ntz")).write.parquet(str(tmp_path / "chunks.parquet"))
    book = spark.createDataFrame([(1, "text", "moon")], "id long, modality string, term string")
    book.write.parquet(str(tmp_path / "codebook.parquet"))
    found = {r.term: (r.occurrences, r.records) for r in _marked(spark, str(tmp_path)).collect()}
    assert found["moon"] == (4, 2)
