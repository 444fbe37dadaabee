import random

import numpy as np
import pytest

from kelpline.llm import repetition as rp


def share_by_definition(words, run=4):
    seen, covered = set(), set()
    for i in range(len(words) - run + 1):
        gram = tuple(words[i : i + run])
        if gram in seen:
            covered |= set(range(i, i + run))
        seen.add(gram)
    return len(covered) / len(words) if words else 0.0


@pytest.mark.parametrize("seed", range(20))
def test_share_equals_its_definition(seed):
    rng = random.Random(seed)
    words = [rng.choice("abcd") for _ in range(rng.randint(0, 60))]
    assert rp.repeated_word_share(words) == pytest.approx(share_by_definition(words))


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (500, 3)), [[9, 9, 9], [-8, 9, 9]]])
    score = rp.IsolationForest.fit(x).score(x)
    assert set(np.argsort(-score)[:2]) == {500, 501}
    assert 0 < score.min() and score.max() < 1


def test_threshold_stands_below_the_positives():
    score, label = np.array([0.4, 0.42, 0.45, 0.7, 0.8]), np.array([0, 0, 0, 1, 1], dtype=bool)
    t = rp.calibrate(score, label)
    assert 0.45 < t < 0.7
    assert rp.calibrate(score, ~label | label) <= score.min()
    assert rp.calibrate(score, np.zeros(5, bool)) == pytest.approx(0.45)
    assert rp.calibrate(np.zeros(0), np.zeros(0, bool)) == 0.0


def test_odd_rows(spark):
    plain = "one two three four five six seven eight nine ten"
    rows = [(1, plain, "x"), (2, "la la la la la la la la la la", "x"), (3, None, "x"), (4, "", "x"), (5, "[x] ...", "x"),
            (2, "la la la la la la la la la la", "y"), (None, plain, "z"), (6, "again and again we sing it\n" * 4000, "x")]
    rows += [(10 + i, " ".join(f"w{i}{j}" for j in range(30)), "x") for i in range(30)]
    df = spark.createDataFrame(rows, "song_id long, lyrics string, anomaly_score string")
    out = {r["song_id"]: r for r in rp.repetition(df, "song_id", "lyrics").collect()}
    assert sorted(out) == [1, 2, 3, 4, 5, 6, *range(10, 40)]
    assert {k for k, r in out.items() if r["mostly_repetition"]} == {2, 6}
    assert out[3]["n_words"] == out[4]["n_words"] == 0 and out[3]["repeated_share"] == 0.0
    assert rp.repetition(df.where("false"), "song_id", "lyrics").count() == 0
    with pytest.raises(ValueError):
        rp.repetition(df, "song_id", "nothing")


def test_all_true_cases_are_candidates(spark, data):
    df = spark.read.parquet(f"{data}/lyrics_sample.parquet")
    out = rp.repetition(df, "song_id", "lyrics").toPandas()
    assert out[out.repeated_share > 0.5].candidate.all()
    assert (out.repeated_share > 0.5).sum() == out.mostly_repetition.sum()
