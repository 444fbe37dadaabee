import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpline.llm import splitting as sp


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.data())
def test_range_maximum(values, data):
    lo = data.draw(st.integers(0, len(values) - 1))
    hi = data.draw(st.integers(lo + 1, len(values)))
    got = sp.RangeMax(np.array(values, dtype=np.int64)).query(lo, hi)
    part = values[lo:hi]
    assert got == lo + max(i for i, v in enumerate(part) if v == max(part))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n。é😀", max_size=400), st.integers(8, 40))
def test_pieces_cover_the_text(text, limit):
    overlap, shortest = limit // 5, limit // 2
    pieces = sp.split_text(text, limit, overlap, shortest)
    assert (pieces == []) == (text == "")
    for (a, b, _), nxt in zip(pieces, [*pieces[1:], None]):
        assert 0 < b - a <= limit
        if nxt:
            assert a < nxt[0] <= b and b - nxt[0] <= overlap and nxt[1] > b
    if pieces:
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        rebuilt = text[: pieces[0][1]]
        for (_, before, _), (a, b, _) in zip(pieces, pieces[1:]):
            rebuilt += text[before:b]
            assert a <= before
        assert rebuilt == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aaab. \n。é", max_size=400), st.integers(10, 40))
def test_pieces_share_what_they_can(text, limit):
    """A word start within the overlap, the first one, or else exactly the overlap."""
    overlap, shortest = limit // 5, limit // 2
    at, _ = sp.cut_points(text)
    pieces = sp.split_text(text, limit, overlap, shortest)
    for (start, end, _), (nxt, *_) in zip(pieces, pieces[1:]):
        starts = [p for p in at.tolist() if end - overlap <= p < end]
        assert nxt == max(starts[0] if starts else end - overlap, start + 1)


def test_overlap_without_word_starts():
    for text in ("x" * 130 + " ") * 40, ("山" * 130 + "。") * 40:
        pieces = sp.split_text(text, 1500, 100, 750)
        assert len(pieces) > 3 and all(b - c == 100 for (_, b, _), (c, *_) in zip(pieces, pieces[1:]))
    assert sp.cut_points('Go.""""""""""""" Then')[1].tolist() == [sp.SENTENCE]


def test_strongest_boundary_wins():
    text = "aa bb. cc\ndd ee\n\nff gg hh ii jj"
    (_, end, kind), *_ = sp.split_text(text, 24, 0, 8)
    assert text[:end].endswith("\n\n") and kind == "stanza"
    (_, end, kind), *_ = sp.split_text("aaaa aaaa aaaa aaaa", 10, 0, 5)
    assert (end, kind) == (10, "word")  # of equal strengths the rightmost
    assert [k for *_, k in sp.split_text("x" * 50, 20, 5, 10)] == ["none", "none", "end"]


def test_odd_rows(spark):
    long = "word " * 1000
    rows = [(1, "short", 1), (2, None, 2), (3, "", 3), (4, long, 4), (4, long, 5), (None, long, 6), (5, "é" * 1500, 7), (6, "y" * 1501, 8), (7, "z", 1), (7, long, 9)]
    df = spark.createDataFrame(rows, "id long, content string, piece_pos long")
    out = sp.split_oversized(df, "id", "content", order=["piece_pos"]).toPandas()
    assert sorted(out.id.unique()) == [1, 4, 5, 6, 7]
    assert (out.piece.str.len() <= 1500).all() and (out.piece.str.len() == out.end_pos - out.start_pos).all()
    assert sorted(out[out.piece_pos == 1].id) == [4, 6, 7]
    again = out[out.id == 4].sort_values("piece_pos")
    assert "".join(long[a:b] for a, b in zip([0, *again.end_pos[:-1]], again.end_pos)) == long
    assert sp.split_oversized(df.where("false"), "id", "content").count() == 0
    with pytest.raises(ValueError):
        sp.split_oversized(df, "id", "content", limit=10, overlap=8)
