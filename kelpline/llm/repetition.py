"""Repetition inside single texts, found by an isolation forest over rule statistics.

For every text a row of statistics is computed: the share of words in runs that begin again, of words
in repeated lines and stanzas, of the most frequent line, and the share of distinct words.  A forest of
random splits, fitted on a bounded sample, gives every text an anomaly score from its path lengths:
texts that few random splits isolate score high.  The score above which a text is a candidate is
calibrated on labelled rows of the sample, which an exact rule labels; the exact share of repeated
words then confirms the candidates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import check_columns, latest_per_id
from kelpline.runtime import materialize

_WORD = re.compile(r"[^\W_]+")
_STANZA = re.compile(r"\n[^\S\n]*\n\s*")
#: The statistics a text is judged by, in the order in which the forest sees them.
STATISTICS = ["repeated_share", "line_share", "stanza_share", "top_line_share", "distinct_share"]
_TYPE = "struct<n_words:long," + ",".join(f"{s}:double" for s in STATISTICS) + ">"


def repeated_word_share(words: list[str], run: int = 4) -> float:
    """Share of words inside a run of ``run`` consecutive words that also begins at an earlier word."""
    n = len(words)
    if n < run + 1:
        return 0.0
    code, _ = pd.factorize(np.asarray(words, dtype=object))
    gram = code.astype(np.int64)
    for k in range(1, run):  # ids of ever longer runs; factorising keeps them small, so they stay exact
        gram, _ = pd.factorize(gram[: n - k] * n + code[k:])
        gram = gram.astype(np.int64)
    first = np.full(gram.max() + 1, -1)
    first[gram[::-1]] = np.arange(len(gram))[::-1]
    again = first[gram] < np.arange(len(gram))
    cover = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(again)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + run, -1)
    return float((np.cumsum(cover[:n]) > 0).mean())


def _shares(parts: list[list[str]], n: int) -> tuple[float, float]:
    """Share of words in parts that came before; share of the words in the most frequent part."""
    seen: dict[tuple, int] = {}
    repeated = 0
    for p in parts:
        key = tuple(p)
        if key in seen:
            repeated += len(p)
        seen[key] = seen.get(key, 0) + 1
    top = max((len(k) * c for k, c in seen.items() if c > 1), default=0)
    return repeated / n, top / n


def text_statistics(text: str | None, run: int = 4) -> tuple:
    if not text:
        return (0, 0.0, 0.0, 0.0, 0.0, 1.0)
    lowered = text.lower()
    words = _WORD.findall(lowered)
    n = len(words)
    if n == 0:
        return (0, 0.0, 0.0, 0.0, 0.0, 1.0)
    lines = [w for line in lowered.split("\n") if (w := _WORD.findall(line))]
    stanzas = [w for part in _STANZA.split(lowered) if (w := _WORD.findall(part))]
    line_share, top = _shares(lines, n)
    stanza_share, _ = _shares(stanzas, n)
    return (n, repeated_word_share(words, run), line_share, stanza_share, top, len(set(words)) / n)


@dataclass
class IsolationForest:
    """Trees in flat arrays; ``feature`` is -1 at a leaf, whose ``depth`` includes the usual correction."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    depth: np.ndarray
    subsample: int

    @staticmethod
    def _expected(n: np.ndarray | float) -> np.ndarray:
        n = np.asarray(n, dtype=float)
        harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
        return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = 100, subsample: int = 256, seed: int = 7) -> IsolationForest:
        rng = np.random.default_rng(seed)
        m = min(subsample, len(x))
        deepest = max(1, int(np.ceil(np.log2(max(m, 2)))))
        size = 2 ** (deepest + 1)
        feature = np.full((trees, size), -1, dtype=np.int32)
        cut, depth = np.zeros((trees, size)), np.zeros((trees, size))
        child = np.zeros((trees, size), dtype=np.int32)
        for t in range(trees):
            stack = [(0, x[rng.choice(len(x), m, replace=False)], 0)]
            free = 1
            while stack:
                node, rows, d = stack.pop()
                low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
                varied = np.flatnonzero(high > low)
                if d >= deepest or len(rows) <= 1 or len(varied) == 0:
                    depth[t, node] = d + cls._expected(len(rows))
                    continue
                f = int(rng.choice(varied))
                c = rng.uniform(low[f], high[f])
                feature[t, node], cut[t, node], child[t, node] = f, c, free
                left = rows[:, f] <= c
                stack += [(free, rows[left], d + 1), (free + 1, rows[~left], d + 1)]
                free += 2
        return cls(feature, cut, child, depth, m)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (- mean path length / expected path length): near 1 for the anomalous."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                f = self.feature[t, node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] > self.cut[t, node]
                node = np.where(inner, self.child[t, node] + right, node)
            total += self.depth[t, node]
        expected = float(self._expected(self.subsample)) or 1.0
        return 2.0 ** (-total / len(self.feature) / expected)


def calibrate(score: np.ndarray, label: np.ndarray) -> float:
    """A threshold below all labelled positives, by half their distance to the typical negative."""
    if not len(score):
        return 0.0
    typical = float(np.median(score[~label])) if (~label).any() else 0.0
    if not label.any():
        return typical
    lowest = float(score[label].min())
    return lowest - 0.5 * max(0.0, lowest - typical) if lowest > typical else lowest - 0.05


def repetition(
    df: DataFrame,
    id_col: str,
    text_col: str,
    run: int = 4,
    limit: float = 0.5,
    sample_rows: int = 4000,
    trees: int = 100,
    subsample: int = 256,
    seed: int = 7,
    order: list[str] | None = None,
) -> DataFrame:
    """``id_col``, n_words, the statistics, anomaly_score, candidate, mostly_repetition of every text.

    The statistics read whole texts.  The forest and its threshold are fitted on at most ``sample_rows``
    rows of statistics, chosen by a hash of the id, whose labels are given by the exact rule
    (repeated_share above ``limit``); every row is scored.  mostly_repetition holds for candidates whose
    exact share is above ``limit``.  A null, empty or wordless text has no words, shares of 0 and a
    distinct share of 1.  Repeated ids count once (the greatest by ``order``, then text); null ids are
    left out.  An empty table gives an empty result.  Other columns are ignored.
    """
    check_columns(df, id_col, text_col)

    @F.pandas_udf(_TYPE)
    def statistics(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_statistics(t, run) for t in texts], columns=["n_words", *STATISTICS])

    cols = [id_col, text_col, *[c for c in order or [] if c not in (id_col, text_col)]]
    texts = latest_per_id(df.select(*cols), id_col, [text_col], order)
    rows = texts.select(id_col, statistics(F.col(text_col)).alias("_s")).select(id_col, "_s.*")
    rows = materialize(rows, "repetition")
    sample = rows.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(sample_rows).select(*STATISTICS).toPandas()
    x = sample.to_numpy(dtype=float)
    if len(x):
        forest = IsolationForest.fit(x, trees, subsample, seed)
        threshold = calibrate(forest.score(x), x[:, 0] > limit)
    else:
        forest, threshold = None, 0.0

    @F.pandas_udf("double")
    def anomaly(*stats: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.column_stack(stats).astype(float)))

    score = F.lit(0.0) if forest is None else anomaly(*[F.col(s) for s in STATISTICS])
    scored = rows.withColumn("anomaly_score", score).withColumn("candidate", F.col("anomaly_score") >= threshold)
    return scored.withColumn("mostly_repetition", F.col("candidate") & (F.col("repeated_share") > limit))
