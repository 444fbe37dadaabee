"""Queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import (
    encoding,
    languages,
    leakage,
    linkage,
    neighbours,
    relevance,
    repetition,
    sentences,
    splitting,
    term_counts,
)
from kelpline.runtime import materialize, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# 1 -- repetition inside single songs ---------------------------------------------------------------

_REPEATED = r"""
WITH w AS (SELECT song_id, regexp_extract_all(lower(lyrics), '[\p{L}\p{N}]+') AS ws FROM lyrics_sample),
pos AS (SELECT song_id, len(ws) AS n, unnest(range(len(ws))) AS i, ws FROM w),
gram AS (SELECT song_id, i, row_number() OVER (PARTITION BY song_id, ws[i+1], ws[i+2], ws[i+3], ws[i+4] ORDER BY i) AS k
         FROM pos WHERE i + 4 <= n),
hit AS (SELECT DISTINCT song_id, unnest(range(i, i + 4)) AS i FROM gram WHERE k > 1),
share AS (SELECT w.song_id, len(ws) AS n_words, coalesce(h.c, 0) AS c FROM w
          LEFT JOIN (SELECT song_id, count(*) AS c FROM hit GROUP BY 1) h USING (song_id))
"""


def _repetition(spark: SparkSession, root: str) -> DataFrame:
    return repetition.repetition(table(spark, root, "lyrics_sample"), "song_id", "lyrics")


@query(_REPEATED + "SELECT song_id FROM share WHERE c > 0.5 * n_words")
def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return _repetition(spark, root).where("mostly_repetition").select("song_id")


@query(
    _REPEATED + "SELECT song_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words,"
    " CASE WHEN n_words > 0 THEN round(c / n_words, 6) ELSE 0.0 END AS repeated_share FROM share"
)
def p1_repetition(spark: SparkSession, root: str) -> DataFrame:
    return _repetition(spark, root).select("song_id", "n_words", F.round("repeated_share", 6).alias("repeated_share"))


# 3 -- oversized texts ------------------------------------------------------------------------------


def _pieces(spark: SparkSession, root: str) -> DataFrame:
    chunks = splitting.split_oversized(table(spark, root, "chunks"), "chunk_id", "content", order=["loaded_at"])
    songs = splitting.split_oversized(table(spark, root, "lyrics_sample"), "song_id", "lyrics")
    return (
        chunks.withColumnRenamed("chunk_id", "row_id")
        .withColumn("src", F.lit("chunks"))
        .unionByName(songs.withColumnRenamed("song_id", "row_id").withColumn("src", F.lit("lyrics_sample")))
    )


@query("""
SELECT DISTINCT 'chunks' AS src, chunk_id AS row_id FROM chunks WHERE length(content) > 1500
UNION ALL SELECT 'lyrics_sample', song_id FROM lyrics_sample WHERE length(lyrics) > 1500
""")
def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """A record was cut if it has a second piece; there is exactly one of these."""
    return _pieces(spark, root).where("piece_pos = 1").select("src", "row_id")


@query()
def p3_pieces(spark: SparkSession, root: str) -> DataFrame:
    return _pieces(spark, root).select("src", "row_id", "piece_pos", "start_pos", "end_pos", "cut", "piece")


@query("""
WITH t AS (SELECT DISTINCT 'chunks' AS src, chunk_id AS row_id, content AS text FROM chunks WHERE length(content) > 0
UNION ALL SELECT 'lyrics_sample', song_id, lyrics FROM lyrics_sample WHERE length(lyrics) > 0)
SELECT src, row_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest, TRUE AS within, TRUE AS in_order FROM t
""")
def p3_rebuilt(spark: SparkSession, root: str) -> DataFrame:
    """Every text put together from its pieces, each without what it shares with the one before."""
    pieces = _pieces(spark, root)
    of_text = F.array_sort(F.collect_list(F.struct("piece_pos", "start_pos", "end_pos", "piece")))  # the pieces of one text
    rows = pieces.groupBy("src", "row_id").agg(of_text.alias("p"))
    rows = rows.withColumn("before", F.concat(F.array(F.lit(0)), F.slice(F.col("p.end_pos"), 1, F.size("p") - 1)))
    fresh = F.zip_with("p", "before", lambda x, b: F.substr(x["piece"], b - x["start_pos"] + 1))
    shared = F.zip_with("p", "before", lambda x, b: (b >= x["start_pos"]) & (b - x["start_pos"] <= 100) & (x["end_pos"] > b))
    within = F.forall("p", lambda x: (x["end_pos"] - x["start_pos"] <= 1500) & (F.length(x["piece"]) == x["end_pos"] - x["start_pos"]))
    text = F.array_join(fresh, "")
    return rows.select(
        "src", "row_id", F.length(text).alias("n_chars"), F.md5(text.cast("binary")).alias("digest"), within.alias("within"),
        F.forall(shared, lambda ok: ok).alias("in_order"),
    )


# 4 -- characteristic terms -------------------------------------------------------------------------

_WEIGHTS = """
WITH c AS (SELECT DISTINCT chunk_id, content FROM chunks WHERE modality = 'text' AND content IS NOT NULL),
t AS (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[a-záéíóúüñ0-9]+')) AS term FROM c),
v AS (SELECT DISTINCT regexp_replace(lower(term), '^\\s+|\\s+$', '', 'g') AS term FROM codebook WHERE term IS NOT NULL),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM t SEMI JOIN v USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
len AS (SELECT chunk_id, len(regexp_extract_all(lower(content), '[a-záéíóúüñ0-9]+')) AS length FROM c),
n AS (SELECT count(*) AS n, avg(length) AS mean FROM len),
w AS (SELECT chunk_id, term, tf, df, length, ln(1 + tf) * log10(n / df) AS w,
             ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS bm25
      FROM tf JOIN df USING (term) JOIN len USING (chunk_id), n)
""".replace("\\\\", "\\")


def _relevance(spark: SparkSession, root: str) -> DataFrame:
    chunks = table(spark, root, "chunks").where("modality = 'text'")
    return relevance.term_relevance(
        chunks, "chunk_id", "content", table(spark, root, "codebook").where("modality = 'text'"), order=["loaded_at"]
    )


@query(
    _WEIGHTS + "SELECT chunk_id, term FROM (SELECT *, max(w) OVER (PARTITION BY chunk_id) AS best FROM w)"
    " WHERE w > 0 AND w >= best - 1e-9"
)
def p4_found(spark: SparkSession, root: str) -> DataFrame:
    scored = _relevance(spark, root)
    return relevance.most_characteristic(scored, "chunk_id", "log_weight", k=None, tie=1e-9).select("chunk_id", "term")


@query(
    _WEIGHTS + "SELECT chunk_id, term, tf, df, round(bm25, 6) AS bm25, CAST(place AS INTEGER) AS place FROM (SELECT *,"
    " row_number() OVER (PARTITION BY chunk_id ORDER BY round(bm25, 9) DESC, term) AS place FROM w WHERE bm25 > 0)"
    " WHERE place <= 5"
)
def p4_terms(spark: SparkSession, root: str) -> DataFrame:
    best = relevance.most_characteristic(_relevance(spark, root), "chunk_id")
    return best.select("chunk_id", "term", "tf", "df", F.round("bm25", 6).alias("bm25"), "place")


# 7 -- frequencies of all terms ---------------------------------------------------------------------

_COUNTS = """
WITH c AS (SELECT DISTINCT chunk_id, content FROM chunks WHERE modality = 'text' AND content IS NOT NULL),
t AS (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[a-záéíóúüñ0-9]+')) AS term FROM c),
d AS (SELECT term, count(*) AS occurrences, count(DISTINCT chunk_id) AS records FROM t GROUP BY term
      UNION ALL SELECT DISTINCT regexp_replace(lower(term), '^\\s+|\\s+$', '', 'g'), 0, 0 FROM codebook WHERE term IS NOT NULL),
s AS (SELECT term, CAST(sum(occurrences) AS BIGINT) AS occurrences, CAST(sum(records) AS BIGINT) AS records
      FROM d WHERE term <> '' GROUP BY term),
m AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.2 * (SELECT count(*) FROM c) THEN 'common'
      ELSE 'useful' END AS mark FROM s)
""".replace("\\\\", "\\")


def _marked(spark: SparkSession, root: str) -> DataFrame:
    """The chunks arrive in two batches; the second one also brings chunks that the first one had."""
    chunks = table(spark, root, "chunks").where("modality = 'text'")
    span = chunks.agg(F.min("loaded_at").alias("a"), F.max("loaded_at").alias("b")).first()
    store = term_counts.TermCounts(spark)
    if span["a"] is None:  # no rows, or none with a time
        store.apply(term_counts.record_changes(None, chunks, "chunk_id", "content", ["loaded_at"]), "all")
    else:
        cut = F.lit(span["a"] + 0.75 * (span["b"] - span["a"]))
        timeless = F.col("loaded_at").isNull()
        first, later = chunks.where((F.col("loaded_at") <= cut) | timeless), chunks.where(F.col("loaded_at") > cut)
        store.apply(term_counts.record_changes(None, first, "chunk_id", "content", ["loaded_at"]), "first")
        touched = materialize(later.select("chunk_id").distinct(), "touched")  # of known size: few are sent, many shuffled
        known = first.join(touched, "chunk_id", "left_semi")
        store.apply(term_counts.record_changes(known, later, "chunk_id", "content", ["loaded_at"]), "later")
    return term_counts.marked_terms(store, table(spark, root, "codebook").where("modality = 'text'"))


@query(_COUNTS + "SELECT term, mark FROM m WHERE mark <> 'useful'")
def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return _marked(spark, root).where("mark <> 'useful'").select("term", "mark")


@query(_COUNTS + "SELECT term, occurrences, records, mark FROM m")
def p7_terms(spark: SparkSession, root: str) -> DataFrame:
    return _marked(spark, root)


# 8 -- token ids ------------------------------------------------------------------------------------


@query()
def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, root, "documents"), "doc_id", "text", unique_ids=True)


# 9 -- leaked evaluation passages -------------------------------------------------------------------


def _leaks(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaked_items(
        table(spark, root, "documents"), "doc_id", "text", table(spark, root, "eval_items"), "item_id", "passage"
    )


@query()
def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return _leaks(spark, root).select("doc_id", "item_id")


@query()
def p9_leaks(spark: SparkSession, root: str) -> DataFrame:
    return _leaks(spark, root)


# 2 -- most similar vectors -------------------------------------------------------------------------


@query("""
WITH v AS (SELECT DISTINCT chunk_id, modality, hist FROM histograms WHERE hist IS NOT NULL
           AND len(list_filter(hist, lambda x: isnan(x))) = 0 AND len(list_filter(hist, lambda x: x <> 0)) > 0)
SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b FROM v a JOIN v b
ON a.modality = b.modality AND a.chunk_id < b.chunk_id AND len(a.hist) = len(b.hist)
WHERE list_cosine_similarity(a.hist::DOUBLE[], b.hist::DOUBLE[]) >= 0.95
""")
def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Every vector is a query; at the floor of 0.95 its ten best partners are all of them."""
    best = neighbours.most_similar(
        table(spark, root, "histograms"), "chunk_id", "hist", 10, "modality", floor=0.95, order=["loaded_at"]
    )
    return best.select(F.least("a", "b").alias("chunk_a"), F.greatest("a", "b").alias("chunk_b")).distinct()


_TEN = """
WITH v AS (SELECT DISTINCT chunk_id, modality, hist::DOUBLE[] AS v FROM histograms WHERE hist IS NOT NULL),
u AS (SELECT * FROM v WHERE len(list_filter(v, lambda x: isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
d AS (SELECT a.chunk_id, b.chunk_id AS similar_id, list_cosine_similarity(a.v, b.v) AS sim FROM u a JOIN u b
      ON a.modality = b.modality AND a.chunk_id <> b.chunk_id AND len(a.v) = len(b.v) WHERE a.chunk_id % 100 = 0)
SELECT chunk_id, similar_id, round(sim, 6) AS similarity FROM d
QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY round(sim, 9) DESC, similar_id) <= 10
"""


def _ten(spark: SparkSession, root: str, queries: Callable[[Column], Column] | None) -> DataFrame:
    best = neighbours.most_similar(
        table(spark, root, "histograms"), "chunk_id", "hist", 10, "modality", queries=queries, order=["loaded_at"]
    )
    return best.select(F.col("a").alias("chunk_id"), F.col("b").alias("similar_id"), F.round("sim", 6).alias("similarity"))


@query(_TEN)
def p2_nearest(spark: SparkSession, root: str) -> DataFrame:
    """The ten most similar vectors of every hundredth chunk, among all rows."""
    return _ten(spark, root, lambda c: c % 100 == 0)


@query()
def p2_similar(spark: SparkSession, root: str) -> DataFrame:
    """The ten most similar vectors of every vector, each from the cells nearest to it."""
    return _ten(spark, root, None)


@query("SELECT TRUE AS at_least_nine_tenths")
def p2_recall(spark: SparkSession, root: str) -> DataFrame:
    """Do the lists of all vectors hold nine tenths of what a scan of all rows finds for every hundredth one?"""
    want, found = _ten(spark, root, lambda c: c % 100 == 0), _ten(spark, root, None)
    both = want.select("chunk_id", "similar_id").join(found.select("chunk_id", "similar_id", F.lit(1).alias("hit")), ["chunk_id", "similar_id"], "left")
    return both.agg((F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("at_least_nine_tenths"))


# 5 -- similarity clusters --------------------------------------------------------------------------


def _vectors(spark: SparkSession, root: str, which: str = "modality IS NOT NULL") -> DataFrame:
    """Vectors of both tables under one id: the two sources are clustered in the same rounds."""

    def rows(src: str, name: str, key: str, vec: str, loaded) -> DataFrame:
        return table(spark, root, name).where(which).select(
            F.concat_ws(":", F.lit(src), F.col(key).cast("string")).alias("id"),
            F.concat_ws("/", F.lit(src), "modality").alias("grp"),
            F.col(vec).alias("vec"),
            loaded.cast("timestamp_ntz").alias("loaded_at"),
        )

    hist = rows("histograms", "histograms", "chunk_id", "hist", F.col("loaded_at"))
    return hist.unionByName(rows("codebook", "codebook", "id", "centroid", F.lit(None)))


def _src(id: Column | str) -> Column:
    return F.element_at(F.split(id, ":"), 1)


def _key(id: Column | str) -> Column:
    return F.element_at(F.split(id, ":"), 2).cast("long")


@query("""
WITH v AS (
  SELECT DISTINCT 'histograms' AS src, chunk_id AS key, modality, hist::DOUBLE[] AS v FROM histograms WHERE hist IS NOT NULL
  UNION ALL SELECT DISTINCT 'codebook', id, modality, centroid::DOUBLE[] FROM codebook WHERE centroid IS NOT NULL),
u AS (SELECT * FROM v WHERE len(list_filter(v, lambda x: isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0)
SELECT a.src, a.key AS key_a, b.key AS key_b FROM u a JOIN u b
ON a.src = b.src AND a.modality = b.modality AND a.key < b.key AND len(a.v) = len(b.v)
WHERE list_cosine_similarity(a.v, b.v) >= 0.74
""")
def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """All pairs within a group, as the definition of this query has it."""
    found = linkage.similarity_clusters(_vectors(spark, root), "id", "vec", "grp", order=["loaded_at"])
    found = materialize(found.select("cluster", _src("id").alias("src"), _key("id").alias("key")), "clusters")
    return linkage.cluster_pairs(found, ["cluster", "src"], "key").select("src", "key_a", "key_b")


@query("""
WITH v AS (
  SELECT DISTINCT 'histograms' AS src, chunk_id AS key, modality, hist::DOUBLE[] AS v FROM histograms WHERE hist IS NOT NULL AND modality <> 'text'
  UNION ALL SELECT DISTINCT 'codebook', id, modality, centroid::DOUBLE[] FROM codebook WHERE centroid IS NOT NULL AND modality <> 'text'),
u AS (SELECT * FROM v WHERE len(list_filter(v, lambda x: isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT a.src, a.modality, a.key, b.key AS other, list_cosine_similarity(a.v, b.v) AS sim FROM u a JOIN u b
  ON a.src = b.src AND a.modality = b.modality AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.74),
m AS (SELECT src, modality, key, min(CAST(other AS VARCHAR)) AS cluster, avg(sim) AS t FROM s GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY src, modality, cluster ORDER BY round(t, 7) DESC, CAST(key AS VARCHAR)) AS place FROM m)
SELECT src, modality, CAST(cluster AS BIGINT) AS cluster, count(*) AS size, round(avg(t), 6) AS cohesion,
array_to_string(list(CAST(key AS VARCHAR) ORDER BY place) FILTER (place <= 3), ' ') AS typical_keys FROM p GROUP BY src, modality, cluster
""")
def p5_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Size, cohesion and the three most typical members of every group."""
    rows = _vectors(spark, root, "modality <> 'text'")
    found = materialize(linkage.similarity_clusters(rows, "id", "vec", "grp", order=["loaded_at"]), "clusters")
    told = linkage.describe_clusters(rows, found, "id", "vec", "grp", order=["loaded_at"])
    return told.select(
        _src("cluster").alias("src"), F.element_at(F.split("grp", "/"), 2).alias("modality"),
        _key("cluster").alias("cluster"), "size", F.round("cohesion", 6).alias("cohesion"),
        F.array_join(F.transform("typical_ids", lambda i: _key(i).cast("string")), " ").alias("typical_keys"),
    )


# 6 -- languages of songs and of their stretches ----------------------------------------------------


def _languages(spark: SparkSession, root: str) -> DataFrame:
    songs = table(spark, root, "lyrics_sample")
    model = languages.fit_languages(
        table(spark, root, "lang_examples"), "content", "lang", songs, "song_id", "lyrics", "lang"
    )
    return languages.judged_languages(songs, "song_id", "lyrics", "lang", model)


@query()
def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return _languages(spark, root).where("label_state <> 'right'").select("song_id", "first_line", "lang")


@query()
def p6_stretches(spark: SparkSession, root: str) -> DataFrame:
    """Every stretch of every song, with its confidence and what the label is worth."""
    found = _languages(spark, root)
    return found.select(
        "song_id", "first_line", "last_line", "n_lines", "lang", F.round("confidence", 4).alias("confidence"), "labelled", "label_state"
    )


# 10 -- sentences -----------------------------------------------------------------------------------


def _sentences(spark: SparkSession, root: str) -> DataFrame:
    return sentences.split_sentences(table(spark, root, "documents"), "doc_id", "text", "lang", unique_ids=True)


@query()
def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return _sentences(spark, root).select("doc_id", "start_pos", "end_pos")


@query()
def p10_sentences(spark: SparkSession, root: str) -> DataFrame:
    return _sentences(spark, root)
