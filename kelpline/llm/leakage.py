"""Evaluation passages inside a corpus: a prefix-filtered set join with exact verification.

A document leaks an item if both share ``window`` consecutive words.  Every window of a passage holds
``window - shingle + 1`` word shingles in a row, and a document that contains the window contains them all.
One pass over the corpus, whatever the number of items, keeps the stretches of at least so many shingles in a row that
may belong to passages, told by a sketch of bounded size; the rest of a text cannot leak.  The shingles of these
stretches are counted, every window of a passage keeps its rarest one as its prefix (a window with a shingle that
no stretch holds is gone), stretches and prefixes are joined, the position must leave room for the whole
window within the stretch, and the words of the window are compared.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import check_columns
from kelpline.runtime import materialize

#: The sketch of the passages' shingles has 16 bits for each, but no more than these: 32 MB.
MOST_BITS = 1 << 28


@lru_cache(maxsize=1)
def _patterns():
    import regex

    # accents and invisible characters: marks, format and control characters but for white space, fillers
    hidden = regex.compile(r"[\p{M}\p{Cf}\u115f\u1160\u3164\uffa0]|(?!\s)\p{Cc}")
    return hidden, regex.compile(r"[\p{L}\p{N}]+")


def plain_words(text: str | None) -> list[str]:
    """Runs of letters and digits without case, accents and invisible characters."""
    if not text:
        return []
    hidden, word = _patterns()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.casefold())
        text = hidden.sub("", text)
    elif not text.isprintable():
        text = hidden.sub("", text)
    return word.findall(text.lower())


def word_hashes(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, dtype=np.uint64)
    return pd.util.hash_array(np.asarray(words, dtype=object), categorize=True)


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; equal runs have equal hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        out ^= out >> np.uint64(29)
    return out


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of every hash in a sketch of ``bits``, a power of two."""
    with np.errstate(over="ignore"):
        second = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h & np.uint64(bits - 1), (second >> np.uint64(17)) & np.uint64(bits - 1)


def _holds(sketch: np.ndarray, h: np.ndarray) -> np.ndarray:
    bits = len(sketch) * 64
    found = np.ones(len(h), dtype=bool)
    for at in _places(h, bits):
        found &= (sketch[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def _sketch(hashes: DataFrame, most_bits: int) -> np.ndarray:
    """Bits of all hashes; built by the executors, word by word."""
    n = hashes.count()
    bits = min(most_bits, 1 << max(10, (16 * n - 1).bit_length()))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.concatenate(_places(batch["h"].to_numpy().view(np.uint64), bits))
            yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "value": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    told = hashes.mapInPandas(words, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value"))
    out = np.zeros(bits // 64, dtype=np.uint64)
    rows = iter(told.toLocalIterator())  # at most as many as the sketch has words
    while part := [tuple(r) for _, r in zip(range(100_000), rows)]:
        word, value = np.array(part, dtype=np.int64).T
        out[word] = value.view(np.uint64)
    return out


def _stretches(sketch, window: int, shingle: int):
    """(doc, at, words): stretches of words that may hold a window, with the place of their first word."""
    per = window - shingle + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [plain_words(t) for t in batch["text"]]
            size = np.array([len(w) for w in words])
            first = np.cumsum(size) - size
            flat = [w for ws in words for w in ws]
            h = shingle_hashes(word_hashes(flat), shingle)
            held = _holds(sketch.value, h)
            for k in range(1, shingle):  # shingles over the end of a text
                over = first[1:] - k
                held[over[(over >= 0) & (over < len(held))]] = False
            edge = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]])))
            # two texts may touch: a stretch ends where its text does, as the shingles over the end are not held
            begin, end = edge[::2], edge[1::2]
            long = end - begin >= per
            begin, end = begin[long], end[long]
            row = np.searchsorted(first, begin, side="right") - 1
            docs = batch["doc"].to_numpy()
            if not len(begin):
                continue
            yield pd.DataFrame(
                {"doc": docs[row], "at": begin - first[row], "words": [flat[a : b + shingle - 1] for a, b in zip(begin.tolist(), end.tolist())]}
            )

    return run


def _item_words(window: int, shingle: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [plain_words(t) for t in batch["passage"]]
            keep = [k for k, w in enumerate(words) if len(w) >= window]
            words = [words[k] for k in keep]
            if not keep:
                continue
            h = [shingle_hashes(word_hashes(w), shingle).view(np.int64) for w in words]
            yield pd.DataFrame({"item": batch["item"].to_numpy()[keep], "words": words, "h": h})

    return run


def _shingles_of(window: int, shingle: int):
    """(h, doc, at, back, around) of every shingle of the stretches: its place in the text and the words around it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, at, words in zip(batch["doc"], batch["at"], batch["words"]):
                words = list(words)
                for k, h in enumerate(shingle_hashes(word_hashes(words), shingle).view(np.int64).tolist()):
                    lo = max(0, k - (window - shingle))
                    out.append((h, doc, at + k, k - lo, words[lo : k + window]))
            if out:
                yield pd.DataFrame(out, columns=["h", "doc", "at", "back", "around"])

    return run


def _prefixes(window: int, shingle: int):
    """(h, item, s, off, words): of every window of a passage, from word s, its rarest shingle, at s + off."""
    per = window - shingle + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, words, told in zip(batch["item"], batch["words"], batch["told"]):
                words, h, n = list(words), [t["h"] for t in told], np.array([t["n"] for t in told])
                for s in range(len(h) - per + 1):
                    part = n[s : s + per]
                    if part.min() > 0:
                        off = int(part.argmin())
                        out.append((h[s + off], item, s, off, words[s : s + window]))
            if out:
                yield pd.DataFrame(out, columns=["h", "item", "s", "off", "words"])

    return run


def leaked_items(
    corpus: DataFrame,
    doc_col: str,
    text_col: str,
    items: DataFrame,
    item_col: str,
    passage_col: str,
    window: int = 12,
    shingle: int = 5,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """(``doc_col``, ``item_col``, n_windows, first_word): one row for every leaked item of every document.

    n_windows counts the shared windows of the passage, first_word is the earliest shared word of the
    document.  Words are runs of letters and digits without case, accents and invisible characters.
    Passages or documents that are null, empty or shorter than a window have no rows; repeated rows of
    an id count once; an empty table on either side gives an empty result.  Other columns are ignored.
    ``most_bits``, a power of two, bounds the sketch; a small one lets more through, and changes no result.
    """
    check_columns(corpus, doc_col, text_col)
    check_columns(items, item_col, passage_col)
    if not 1 < shingle <= window:
        raise ValueError("1 < shingle <= window must hold")
    spark = corpus.sparkSession
    # no bound on the length: one character can be several words when it is taken apart
    rows = corpus.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).where(F.col("doc").isNotNull() & (F.length("text") > 0))
    asked = items.select(F.col(item_col).alias("item"), F.col(passage_col).alias("passage"))
    asked = asked.where(F.col("item").isNotNull() & F.col("passage").isNotNull()).distinct()
    doc_type, item_type = rows.schema["doc"].dataType.simpleString(), asked.schema["item"].dataType.simpleString()
    passages = asked.mapInPandas(_item_words(window, shingle), f"item {item_type}, words array<string>, h array<long>")
    passages = materialize(passages, "passages")
    known = passages.select(F.explode("h").alias("h")).distinct()
    sketch = spark.sparkContext.broadcast(_sketch(known, most_bits))
    held = rows.mapInPandas(_stretches(sketch, window, shingle), f"doc {doc_type}, at long, words array<string>")
    held = materialize(held, "stretches")
    sketch.destroy()
    grams = held.mapInPandas(_shingles_of(window, shingle), f"h long, doc {doc_type}, at long, back int, around array<string>")
    counts = grams.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    place = passages.select("item", "words", F.posexplode("h").alias("pos", "h")).join(counts, "h", "left")
    told = F.transform(F.array_sort(F.collect_list(F.struct("pos", "h", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: F.struct(x["h"], x["n"]))
    # one row a passage: a passage's shingles come together again
    rarity = place.groupBy("item", "words").agg(told.alias("told"))
    prefixes = rarity.mapInPandas(_prefixes(window, shingle), f"h long, item {item_type}, s int, off int, words array<string>")
    prefixes = materialize(prefixes, "prefixes")  # with a known size: small ones are sent, and no shingle is shuffled
    found = grams.join(prefixes, "h").where("back >= off").where(F.slice("around", F.col("back") - F.col("off") + 1, window) == F.col("words"))
    return (
        found.groupBy("doc", "item")
        .agg(F.countDistinct("s").alias("n_windows"), F.min(F.col("at") - F.col("off")).alias("first_word"))
        .select(F.col("doc").alias(doc_col), F.col("item").alias(item_col), "n_windows", "first_word")
    )
