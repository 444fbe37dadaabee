"""How characteristic a term is of a record: probabilistic relevance weighting.

``bm25 = ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average length))``

Term frequency saturates through ``k1``, long records are discounted through ``b``.  Next to it every
row carries the sublinear weight ``ln(1 + tf) * log10(N / df)`` of the histogram pipeline, from the same
statistics.  N, df and the average length are counted over all records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kelpline.llm.common import check_columns, clean_term, grouped_per_id, terms_of
from kelpline.runtime import materialize

#: A vocabulary of up to so many terms is sent to every task; a larger one is joined by a shuffle.
BROADCAST_TERMS = 200_000


def vocabulary(codebook: DataFrame, term_col: str = "term") -> DataFrame:
    """Distinct cleaned terms of a codebook; null and blank ones are left out."""
    term = clean_term(F.col(term_col)).alias("term")
    return codebook.select(term).where(F.length("term") > 0).distinct()


def record_terms(
    records: DataFrame,
    id_col: str,
    text_col: str,
    terms: DataFrame | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """(id, length, terms: array of (term, tf)) of every record with a non-null text.

    Tokenising, counting and collecting share one shuffle, by the id.  With ``terms``, only these are
    kept, while ``length`` still counts every token.
    """
    check_columns(records, id_col, text_col)
    docs = grouped_per_id(
        records.select(id_col, text_col, *[c for c in order or [] if c not in (id_col, text_col)]), id_col, [text_col], order
    ).where(F.col(text_col).isNotNull())
    tokens = docs.select(F.col(id_col), terms_of(F.col(text_col)).alias("_tokens"))
    rows = tokens.select(id_col, F.size("_tokens").alias("length"), F.explode_outer("_tokens").alias("_token"))
    if terms is None:
        rows = rows.withColumnRenamed("_token", "term")
    else:
        if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
            terms = F.broadcast(terms)
        rows = rows.join(terms.withColumnRenamed("term", "_known"), F.col("_token") == F.col("_known"), "left")
        rows = rows.select(id_col, "length", F.col("_known").alias("term"))
    counted = rows.groupBy(id_col, "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    pair = F.when(F.col("term").isNotNull(), F.struct("term", "tf"))
    return counted.groupBy(id_col).agg(F.max("length").alias("length"), F.collect_list(pair).alias("terms"))


def term_relevance(
    records: DataFrame,
    id_col: str,
    text_col: str,
    codebook: DataFrame | None = None,
    term_col: str = "term",
    k1: float = 1.2,
    b: float = 0.75,
    order: list[str] | None = None,
) -> DataFrame:
    """One row per (record, term): ``id_col``, term, tf, length, df, n_records, bm25, log_weight.

    Records with a null text or null id do not count; an empty text counts in N with length 0 and has
    no rows; of repeated ids the greatest (``order``, text) counts once.  With ``codebook``, rows come
    out for its terms only (lower-cased, without outer white space; null, blank and repeated ones are
    dropped).  An empty table gives an empty result.  Other columns are ignored.
    """
    terms = None if codebook is None else vocabulary(codebook, term_col)
    per_record = materialize(record_terms(records, id_col, text_col, terms, order), "record-terms")
    total = per_record.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    n, mean = int(total["n"]), float(total["mean"] or 0.0) or 1.0
    rows = per_record.select(id_col, "length", F.explode("terms").alias("_t")).select(
        id_col, "length", F.col("_t.term").alias("term"), F.col("_t.tf").alias("tf")
    )
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if terms is not None and terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        df = F.broadcast(df)
    idf = F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    damped = F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean))
    return rows.join(df, "term").select(
        id_col,
        "term",
        "tf",
        "length",
        "df",
        F.lit(n).cast("long").alias("n_records"),
        (idf * F.col("tf") * (k1 + 1) / damped).alias("bm25"),
        (F.log1p("tf") * F.log10(F.lit(float(n)) / F.col("df"))).alias("log_weight"),
    )


def most_characteristic(scored: DataFrame, id_col: str, by: str = "bm25", k: int | None = 5, tie: float = 0.0) -> DataFrame:
    """The ``k`` best terms of every record by ``by``; with ``k`` None all terms within ``tie`` of the best.

    Only positive scores count.  Equal scores of the top-k are ordered by term.
    """
    scored = scored.where(F.col(by) > 0)
    if k is None:
        # what is within ``tie`` of the best is in its step or the next one; a rank, unlike a maximum, cuts before the shuffle
        step = F.floor(F.col(by) / (10 * tie)) if tie else F.col(by)
        near = F.dense_rank().over(W.partitionBy(id_col).orderBy(F.desc(step)))
        scored = scored.withColumn("_near", near).where(F.col("_near") <= 2).drop("_near")
        best = F.max(by).over(W.partitionBy(id_col))
        return scored.withColumn("_best", best).where(F.col(by) >= F.col("_best") - tie).drop("_best")
    place = F.row_number().over(W.partitionBy(id_col).orderBy(F.desc(F.round(by, 9)), "term"))
    return scored.withColumn("place", place).where(F.col("place") <= k)
