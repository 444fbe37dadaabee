"""Text normalisation: lower case, tokens, stop words, stems."""

from __future__ import annotations

import glob
import os
import zipfile
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions.stemmer import stem_spanish

#: Fixed value: what a token is, in lower-cased text; any other character separates.
TOKEN = "[a-záéíóúüñ0-9]+"


@lru_cache(maxsize=1)
def stop_words() -> tuple[str, ...]:
    """Spanish and English stop words: the lists that ship in Spark's own jar, read without a session."""
    roots = [os.environ.get("SPARK_HOME", ""), os.path.dirname(pyspark.__file__)]
    jars = [j for root in roots if root for j in glob.glob(os.path.join(root, "jars", "spark-mllib_*.jar"))]
    words: set[str] = set()
    for language in ("spanish", "english"):
        if jars:
            with zipfile.ZipFile(jars[0]) as jar:
                lines = jar.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode().split("\n")
        else:
            from pyspark.ml.feature import StopWordsRemover

            lines = StopWordsRemover.loadDefaultStopWords(language)
        words |= {w.strip().lower() for w in lines if w.strip()}
    return tuple(sorted(words))


@dataclass(frozen=True)
class Analyzer:
    """``drop_stop`` removes stop words before stemming; terms shorter than ``min_length`` after it are dropped."""

    drop_stop: bool = True
    stem: bool = False
    min_length: int = 2

    def tokens(self, text: Column) -> Column:
        """All tokens of a text; null gives an empty array."""
        found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
        return F.coalesce(found, F.array().cast("array<string>"))

    def terms(self, text: Column) -> Column:
        """Tokens without stop words and short ones, before stemming."""
        tokens = self.tokens(text)
        if self.drop_stop:
            stop = F.lit(list(stop_words()))
            tokens = F.filter(tokens, lambda t: ~F.array_contains(stop, t))
        if not self.stem:
            tokens = F.filter(tokens, lambda t: F.length(t) >= self.min_length)
        return tokens

    def exploded(self, df: DataFrame, text_col: str, *keep: str) -> DataFrame:
        """(keep..., pos, term), one row per term.  Every distinct token is stemmed once and joined back."""
        rows = df.select(*keep, F.posexplode(self.tokens(F.col(text_col))).alias("pos", "term"))
        if self.drop_stop:
            rows = rows.where(~F.col("term").isin(*stop_words()))
        if self.stem:
            stems = stem_table(rows.select("term").distinct())
            rows = rows.join(stems, "term").select(*keep, "pos", F.col("stem").alias("term"))
        return rows.where(F.length("term") >= self.min_length).select(*keep, "pos", "term")


def stem_table(tokens: DataFrame, col: str = "term") -> DataFrame:
    """(col, stem) of a table of distinct tokens."""

    @F.pandas_udf("string")
    def stem(words: pd.Series) -> pd.Series:
        return words.map(stem_spanish, na_action="ignore")

    return tokens.select(col, stem(F.col(col)).alias("stem"))


def strip(text: Column) -> Column:
    """Without white space at both ends, any white space."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def query_frame(spark: SparkSession, *texts: str) -> DataFrame:
    """(query_id, text) of a few query strings."""
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, text string")
