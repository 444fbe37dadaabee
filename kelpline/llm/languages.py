"""Languages of texts and of their stretches of lines.

A sparse multinomial logistic regression on TF-IDF character n-grams, trained with follow-the-regularised-
leader (elastic net: l1 makes it sparse, l2 shrinks it) and calibrated by a temperature, scores every
line; the best path over the lines of a text, with a cost for every change of language, gives stretches.

Grams of one to four characters are hashed into a table of fixed size, so the model that is sent to the
tasks does not grow with the data.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm.common import check_columns, latest_per_id

LANGUAGES = ["en", "es", "pt", "fr", "de", "it", "ru"]
#: Spellings of the languages; a code may be followed by - or _ and a country.
SPELLINGS = {
    "en": "en eng english inglés inglês",
    "es": "es spa esp spanish español espanol castellano castilian",
    "pt": "pt por portuguese português portugues",
    "fr": "fr fra fre french français francais",
    "de": "de deu ger german deutsch",
    "it": "it ita italian italiano",
    "ru": "ru rus russian русский",
}
#: A choice of ours: syllables that make a line a filler if it has no other word; one that is missing here counts as a word.
FILLERS = frozenset(
    "la na oh ooh oooh o ah aah uh uhh eh ey hey heya yeah yea yeh ye yo da di du dum do doo doob dooby ba bam bom sha shala "
    "lala nana lalala nanana whoa woah wo wow hm hmm mm mmm mhm hoo ho ha hah haha tra trala ay aye uo ei ai ля ла на о ой эй "
    "ах ох у а да ага е йе йо хей".split()
)
#: A choice of ours: names of sections that may stand before a colon or alone in parentheses.
SECTIONS = (
    "verse chorus bridge intro outro hook refrain instrumental solo interlude coro estribillo estrofa verso puente "
    "refrão ponte refrain couplet pont strophe refrain ritornello strofa припев куплет pre-chorus"
)
_TAG = re.compile(r"^\s*(\[[^\]]*\]\s*)+$|^\s*\(?\s*(x\s*\d+|\d+\s*x)\s*\)?\s*$", re.I)
_SECTION = re.compile(
    r"^\s*\(?\s*(" + "|".join(re.escape(s) for s in sorted(set(SECTIONS.split()), key=len, reverse=True)) + r")\s*\d*\s*(\)|:)\s*$", re.I
)
_LETTERS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 18


def language_of_label(label: Column) -> Column:
    """The language that a label names; null for missing labels, placeholders and other languages."""
    plain = F.regexp_replace(F.lower(label), r"(?U)^\s+|\s+$", "")
    base = F.regexp_replace(plain, r"^([a-z]{2,3})[-_].*$", "$1")
    out = F.lit(None).cast("string")
    for code, words in SPELLINGS.items():
        out = F.when(base.isin(words.split()), code).otherwise(out)
    return out


def line_words(line: str) -> str | None:
    """The words of a line, lower-cased; None for lines without a language."""
    if not line.isascii():
        line = unicodedata.normalize("NFC", line)
    if _TAG.match(line) or _SECTION.match(line):
        return None
    words = _LETTERS.findall(line.lower())
    if not words or all(w in FILLERS for w in words):
        return None
    return " ".join(words)


def without_accents(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c) or c == "\u0306")
    return unicodedata.normalize("NFC", plain)


def hashed_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every gram of one to four characters of every text; texts are padded by a space."""
    joined = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    size = np.array([len(t) + 2 for t in texts])
    row = np.repeat(np.arange(len(texts)), size)
    buckets, rows = [], []
    code = np.zeros(len(joined), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, 5):
            if len(joined) < n:
                break
            code = code[: len(joined) - n + 1] * np.uint64(0x100000001B3) + joined[n - 1 :] + np.uint64(n)
            inside = row[: len(code)] == row[n - 1 :]
            mixed = code[inside] * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((mixed >> np.uint64(64 - 18)).astype(np.int64))
            rows.append(row[: len(code)][inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(rows)


@dataclass
class LanguageModel:
    """``weight`` (buckets x languages) already holds the idf factor; ``idf2`` is the squared idf."""

    weight: np.ndarray
    idf2: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, len(LANGUAGES)))
        bucket, row = hashed_grams(texts)
        norm = np.sqrt(np.bincount(row, self.idf2[bucket], len(texts)))
        w = self.weight[bucket]
        total = np.column_stack([np.bincount(row, w[:, k], len(texts)) for k in range(len(LANGUAGES))])
        return (total / np.maximum(norm, 1e-9)[:, None] + self.bias) / self.temperature

    def log_probabilities(self, texts: list[str]) -> np.ndarray:
        s = self.scores(texts)
        s -= s.max(1, keepdims=True, initial=-np.inf)
        return s - np.log(np.exp(s).sum(1, keepdims=True))


def train(
    texts: list[str],
    labels: list[str],
    epochs: int = 6,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.02,
    held_out: float = 0.15,
    seed: int = 3,
) -> LanguageModel:
    """Fit by FTRL-proximal with per-coordinate rates; the held-out share only sets the temperature."""
    rng = np.random.default_rng(seed)
    target = np.array([LANGUAGES.index(x) for x in labels])
    bucket, row = hashed_grams(texts)
    n, k = len(texts), len(LANGUAGES)
    pair = np.unique(row * BUCKETS + bucket)
    df = np.bincount(pair % BUCKETS, minlength=BUCKETS)
    idf = np.log((1 + n) / (1 + df)) + 1.0
    held = rng.random(n) < held_out
    examples = []
    order = np.argsort(row, kind="stable")
    bounds = np.searchsorted(row[order], np.arange(n + 1))
    for i in range(n):
        at, tf = np.unique(bucket[order[bounds[i] : bounds[i + 1]]], return_counts=True)
        x = tf * idf[at]
        examples.append((at, x / np.sqrt((tf * idf[at] ** 2).sum())))
    z, g2 = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    zb, gb = np.zeros(k), np.zeros(k)

    def weights(zz: np.ndarray, gg: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(gg)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(np.flatnonzero(~held)):
            at, x = examples[i]
            w, wb = weights(z[at], g2[at]), weights(zb, gb)
            s = x @ w + wb
            p = np.exp(s - s.max())
            p /= p.sum()
            p[target[i]] -= 1
            g = x[:, None] * p[None, :]
            rate = (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / alpha
            z[at] += g - rate * w
            g2[at] += g * g
            rb = (np.sqrt(gb + p * p) - np.sqrt(gb)) / alpha
            zb += p - rb * wb
            gb += p * p
    model = LanguageModel((weights(z, g2) * idf[:, None]).astype(np.float32), (idf**2).astype(np.float32), weights(zb, gb))
    check = np.flatnonzero(held)
    if len(check):
        raw, want = model.scores([texts[i] for i in check]), target[check]

        def loss(t: float) -> float:
            s = raw / t
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(want)), want]).mean())

        model.temperature = min(np.geomspace(0.05, 5, 60), key=loss)
    return model


def training_rows(texts: list[str], labels: list[str]) -> tuple[list[str], list[str]]:
    """Lines of the texts with their labels, each also without accents and as a cut-off beginning.

    Beginnings of 3 to 22 characters are often ambiguous; through them the temperature learns to doubt."""
    out: list[str] = []
    langs: list[str] = []
    for text, lang in zip(texts, labels):
        for line in text.split("\n"):
            words = line_words(line)
            if words is None:
                continue
            cut = words[: 3 + zlib.crc32(words.encode()) % 20].strip()
            for variant in dict.fromkeys([words, without_accents(words), cut]):
                out.append(variant)
                langs.append(lang)
    return out, langs


def fit_languages(
    examples: DataFrame,
    text_col: str,
    label_col: str,
    songs: DataFrame | None = None,
    id_col: str | None = None,
    song_text: str | None = None,
    song_label: str | None = None,
    max_examples: int = 5000,
    max_songs: int = 400,
) -> LanguageModel:
    """A model from at most ``max_examples`` labelled examples and the lines of at most ``max_songs``
    labelled texts, both chosen by a hash.  A line of a text is used if a first model, fitted on the
    examples alone, is sure of the language that the text's label names."""
    check_columns(examples, text_col, label_col)
    lang = language_of_label(F.col(label_col)).alias("lang")
    known = examples.select(F.col(text_col).alias("text"), lang).where("text is not null and lang is not null")
    rows = known.orderBy(F.xxhash64("text"), "text").limit(max_examples).collect()
    if not rows:
        raise ValueError("there is no labelled example of a known language")
    texts, labels = training_rows([r["text"] for r in rows], [r["lang"] for r in rows])
    model = train(texts, labels)
    if songs is None:
        return model
    label = language_of_label(F.col(song_label)).alias("lang")
    picked = songs.select(F.col(id_col).alias("id"), F.col(song_text).alias("text"), label).where("text is not null and lang is not null")
    picked = picked.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(max_songs).collect()
    more, langs = training_rows([r["text"] for r in picked], [r["lang"] for r in picked])
    if more:
        sure = np.exp(model.log_probabilities(more))
        want = np.array([LANGUAGES.index(x) for x in langs])
        good = sure[np.arange(len(want)), want] > 0.8
        texts += [t for t, g in zip(more, good) if g]
        labels += [x for x, g in zip(langs, good) if g]
        model = train(texts, labels, epochs=4)
    return model


def best_path(log_p: np.ndarray, change: float) -> np.ndarray:
    """Most probable language per line when every change of language costs ``change``."""
    n, k = log_p.shape
    back = np.zeros((n, k), dtype=np.int64)
    score = log_p[0].copy()
    for i in range(1, n):
        top = int(score.argmax())
        moved = score[top] - change
        stay = score >= moved
        back[i] = np.where(stay, np.arange(k), top)
        score = np.where(stay, score, moved) + log_p[i]
    path = np.empty(n, dtype=np.int64)
    path[-1] = score.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def _stretches(spark: SparkSession, model: LanguageModel, change: float):
    """The function from texts to arrays of stretches."""
    sent = spark.sparkContext.broadcast(model)

    def of_batch(texts: pd.Series) -> list[list[dict]]:
        where: list[tuple[int, int]] = []
        words: list[str] = []
        for i, text in enumerate(texts):
            for k, line in enumerate((text or "").split("\n")):
                w = line_words(line)
                if w is not None:
                    where.append((i, k))
                    words.append(w)
        log_p = np.concatenate(
            [sent.value.log_probabilities(words[a : a + 2000]) for a in range(0, len(words), 2000)]
            or [np.zeros((0, len(LANGUAGES)))]
        )
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        a = 0
        while a < len(where):
            b = a
            while b < len(where) and where[b][0] == where[a][0]:
                b += 1
            path = best_path(log_p[a:b], change)
            p = np.exp(log_p[np.arange(a, b), path])
            edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), b - a]
            out[where[a][0]] = [
                {
                    "first_line": where[a + x][1],
                    "last_line": where[a + y - 1][1],
                    "n_lines": y - x,
                    "lang": LANGUAGES[path[x]],
                    "confidence": float(p[x:y].mean()),
                }
                for x, y in zip(edges, edges[1:])
            ]
            a = b
        return out

    @F.pandas_udf("array<struct<first_line:int,last_line:int,n_lines:int,lang:string,confidence:double>>")
    def stretches(texts: pd.Series) -> pd.Series:
        return pd.Series([x for lo in range(0, len(texts), 500) for x in of_batch(texts.iloc[lo : lo + 500])], dtype=object)

    # not deterministic: else the filter that exploding infers would run it a second time
    return stretches.asNondeterministic()


def language_stretches(
    df: DataFrame, id_col: str, text_col: str, model: LanguageModel, change: float = 1.5, order: list[str] | None = None
) -> DataFrame:
    """(``id_col``, first_line, last_line, n_lines, lang, confidence): one row per stretch of lines.

    Lines are the parts between line feeds, from 0.  Blank lines, section tags and filler lines have no
    language, are skipped and end no stretch.  confidence is the mean calibrated probability of the
    language over the stretch's lines.  Null, empty and tag-only texts have no row; repeated ids count
    once (the greatest by ``order``, then text); null ids are left out.  Other columns are ignored.
    """
    check_columns(df, id_col, text_col)
    cols = [id_col, text_col, *[c for c in order or [] if c not in (id_col, text_col)]]
    rows = latest_per_id(df.select(*cols), id_col, [text_col], order)
    found = rows.select(id_col, _stretches(df.sparkSession, model, change)(F.col(text_col)).alias("_s"))
    return found.select(id_col, F.explode("_s").alias("s")).select(id_col, "s.*")


def judged_languages(
    df: DataFrame, id_col: str, text_col: str, label_col: str, model: LanguageModel, change: float = 1.5, order: list[str] | None = None
) -> DataFrame:
    """Stretches with ``labelled`` (the language that the label names) and label_state: ``missing`` (none of the
    languages is named), ``wrong`` (no line is in the labelled language), ``mixed`` (lines in several
    languages) or ``right``.  Otherwise as :func:`language_stretches`."""
    check_columns(df, id_col, text_col, label_col)
    cols = list(dict.fromkeys([id_col, text_col, label_col, *(order or [])]))
    rows = latest_per_id(df.select(*cols), id_col, [text_col, label_col], order)
    found = rows.select(
        F.col(id_col),
        language_of_label(F.col(label_col)).alias("labelled"),
        _stretches(df.sparkSession, model, change)(F.col(text_col)).alias("_s"),
    )
    langs = F.array_distinct(F.transform("_s", lambda x: x["lang"]))
    state = (
        F.when(F.col("labelled").isNull(), "missing")
        .when(~F.array_contains(langs, F.col("labelled")), "wrong")
        .when(F.size(langs) > 1, "mixed")
        .otherwise("right")
    )
    told = found.select(id_col, "labelled", state.alias("label_state"), F.explode("_s").alias("s"))
    return told.select(id_col, "s.*", "labelled", "label_state")
