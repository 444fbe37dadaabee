import random

import pytest

from kelpline.llm import leakage as lk

PASSAGE = "Quintora opens the old gate at noon and twelve small boats leave the café harbour under a pale moon tonight"
W = PASSAGE.split()


def brute(docs, items, window=12):
    grams = {}
    for i, p in items:
        w = lk.plain_words(p)
        for s in range(len(w) - window + 1):
            grams.setdefault(tuple(w[s : s + window]), set()).add(i)
    out = set()
    for d, t in docs:
        w = lk.plain_words(t)
        for s in range(len(w) - window + 1):
            out |= {(d, i) for i in grams.get(tuple(w[s : s + window]), ())}
    return out


def test_words():
    assert lk.plain_words("Ca­fé, ＡＢＣ! don't​ STRASSE straße") == ["cafe", "abc", "don", "t", "strasse", "strasse"]
    assert lk.plain_words(None) == [] and lk.plain_words(" \n ") == []


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item", "'x' as passage")
    i = spark.createDataFrame(items, "item_id long, passage string").selectExpr("*", "1 as doc")
    rows = lk.leaked_items(d, "doc_id", "text", i, "item_id", "passage", **kw).collect()
    assert len(rows) == len({(r["doc_id"], r["item_id"]) for r in rows})
    return {(r["doc_id"], r["item_id"]): (r["n_windows"], r["first_word"]) for r in rows}


def test_cases(spark):
    docs = [
        (1, "Before it. " + PASSAGE + " After it."), (2, " ".join(W[:12])), (3, " ".join(W[:11])), (4, " ".join(W[3:15]).upper().replace(" ", ",\n")),
        (5, "x​ ".join(W[:12])), (6, "­".join(" ".join(W[2:14]))), (7, None), (8, ""), (9, "no"), (2, " ".join(W[:12])),
        (10, " ".join(W[:6] + ["other"] + W[6:12])), (None, PASSAGE), (11, "filler words stand here " * 5000 + PASSAGE.replace("café", "CAFE")),
    ]
    items = [(1, PASSAGE), (2, "too short to leak"), (3, None), (4, " ".join(W[:14]) + " but then it goes on in another way"), (1, PASSAGE)]
    got = run(spark, docs, items)
    assert set(got) == {(1, 1), (1, 4), (2, 1), (2, 4), (4, 1), (6, 1), (6, 4), (11, 1), (11, 4)}
    assert got[1, 1] == (len(W) - 11, 2) and got[2, 1] == (1, 0)
    assert set(got) == brute([d for d in docs if d[0] is not None], items)


@pytest.mark.parametrize("seed, bits", [(0, 1 << 20), (1, 64), (2, 256)])  # small sketches let nearly everything through
def test_like_brute_force(spark, seed, bits):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("a b c d e".split()) for _ in range(n))
    items = [(i, text(rng.randint(3, 25))) for i in range(25)]
    docs = [(i, text(rng.randint(0, 60)) + " " + rng.choice(items)[1]) for i in range(40)]
    assert set(run(spark, docs, items, window=6, shingle=3, most_bits=bits)) == brute(docs, items, 6)


def test_short_texts_of_many_words(spark):
    """One character can be two words."""
    halves = "½ ⅓ ¼ ⅕ ⅙ ⅐"
    assert len(lk.plain_words(halves)) == 12
    assert run(spark, [(1, halves), (2, halves[:-2])], [(1, "so 1 2 1 3 1 4 1 5 1 6 1 7 it is")]) == {(1, 1): (1, 0)}


def test_nothing(spark):
    assert run(spark, [(1, PASSAGE)], [(1, None)]) == {}
    assert run(spark, [(1, None)], [(1, PASSAGE)]) == {}
    with pytest.raises(ValueError):
        run(spark, [(1, "x")], [(1, "y")], window=3, shingle=5)
