"""Queries over the test tables, one or more for every operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions import vectors as vx
from kelpline.functions.text import Analyzer, query_frame, stem_table, stop_words
from kelpline.operators import codebook as cb
from kelpline.operators import fulltext, index, knn, metrics, search
from kelpline.operators import histogram as hg
from kelpline.operators.split import paragraph_chunks
from kelpline.plans import planner
from kelpline.runtime import materialize, new_path, table
from kelpline.sources import media, songs, store
from kelpline.streaming.append import append_stream

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


PLAIN = Analyzer(drop_stop=True, stem=False)
K = 1024
PHRASE = "corazón cansado bajo el puente"
#: Every vector whose id is divisible by this is a query against all rows.
EVERY = 100

_TOKEN = "[a-záéíóúüñ0-9]+"
_STOP = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words()) + ")"
_WS = r"'^\s+|\s+$'"

# -- text functions ----------------------------------------------------------------------------------

_TOKENS = f"regexp_extract_all(lower(text), '{_TOKEN}')"


@query(f"SELECT doc_id, CASE WHEN text IS NULL THEN '' ELSE array_to_string({_TOKENS}, ' ') END AS tokens FROM documents")
def tokenize(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return docs.select("doc_id", F.array_join(PLAIN.tokens(F.col("text")), " ").alias("tokens"))


@query(
    f"SELECT doc_id, CASE WHEN text IS NULL THEN '' ELSE array_to_string(list_filter({_TOKENS}, "
    f"lambda x: length(x) >= 2 AND x NOT IN {_STOP}), ' ') END AS terms FROM documents"
)
def stopword_filter(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return docs.select("doc_id", F.array_join(PLAIN.terms(F.col("text")), " ").alias("terms"))


@query()
def tokenize_stemmed(spark: SparkSession, root: str) -> DataFrame:
    """Every distinct token of the songs with its stem."""
    tokens = table(spark, root, "lyrics_sample").select(F.explode(PLAIN.tokens(F.col("lyrics"))).alias("term")).distinct()
    return stem_table(tokens)


# -- rows and ids ------------------------------------------------------------------------------------


@query("SELECT external_id, title, artist, lyrics FROM lyrics_sample")
def alias_map(spark: SparkSession, root: str) -> DataFrame:
    """Columns under other names and cases come out under the right ones."""
    raw = table(spark, root, "lyrics_sample").select(
        F.col("external_id").alias("LINK"), F.col("title").alias("Song"), F.col("artist").alias("performer"), F.col("lyrics").alias("Text")
    )
    return songs.map_columns(raw)


@query("SELECT song_id, row_number() OVER (ORDER BY song_id) - 1 AS item_id FROM lyrics_sample")
def surrogate_ids(spark: SparkSession, root: str) -> DataFrame:
    return songs.dense_ids(table(spark, root, "lyrics_sample").select("song_id"), ["song_id"])


@query("""
SELECT song_id, CASE WHEN external_id IS NULL OR external_id IN ('', '0')
THEN CAST(row_number() OVER (ORDER BY song_id) - 1 AS VARCHAR) ELSE external_id END AS external_id FROM lyrics_sample
""")
def default_external_id(spark: SparkSession, root: str) -> DataFrame:
    numbered = songs.dense_ids(table(spark, root, "lyrics_sample").select("song_id", "external_id"), ["song_id"])
    return songs.fill_external_id(numbered, "item_id").select("song_id", "external_id")


@query("""
SELECT item_id, regexp_replace(external_id, '^(.*\\.\\d+)\\.\\d+(\\.[^.]+)$', '\\1\\2') AS track
FROM items WHERE modality = 'audio'
""".replace("\\\\", "\\"))
def base_track(spark: SparkSession, root: str) -> DataFrame:
    audio = table(spark, root, "items").where("modality = 'audio'")
    return audio.select("item_id", media.base_track(F.col("external_id")).alias("track"))


@query("""
SELECT item_id, metadata ->> '$.title' AS title, metadata ->> '$.artist' AS artist, metadata ->> '$.label' AS label,
TRY_CAST(metadata ->> '$.n_windows' AS BIGINT) AS n_windows FROM items
""")
def metadata_fields(spark: SparkSession, root: str) -> DataFrame:
    get = lambda k: F.get_json_object("metadata", f"$.{k}")
    rows = table(spark, root, "items")
    return rows.select(
        "item_id", get("title").alias("title"), get("artist").alias("artist"), get("label").alias("label"),
        F.expr("try_cast(get_json_object(metadata, '$.n_windows') as bigint)").alias("n_windows"),
    )


@query("""
SELECT item_id, modality FROM items WHERE item_id IN
(SELECT c.item_id FROM chunks c JOIN histograms h USING (chunk_id))
""")
def semi_join_keep(spark: SparkSession, root: str) -> DataFrame:
    """Items that have a stored histogram."""
    with_hist = table(spark, root, "chunks").join(table(spark, root, "histograms").select("chunk_id"), "chunk_id", "left_semi")
    return table(spark, root, "items").join(with_hist.select("item_id"), "item_id", "left_semi").select("item_id", "modality")


@query("SELECT artist, min(song_id) AS first_song FROM lyrics_sample WHERE artist IS NOT NULL GROUP BY artist ORDER BY 2 LIMIT 25")
def distinct_first_seen(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "lyrics_sample").where("artist is not null")
    return rows.groupBy("artist").agg(F.min("song_id").alias("first_song")).orderBy("first_song").limit(25)


_RECYCLED = 5


@query(f"""
WITH b AS (SELECT title, row_number() OVER (ORDER BY song_id) - 1 AS r, coalesce(external_id, '') AS e, count(*) OVER () AS m FROM lyrics_sample)
SELECT e || '-' || CAST(r + m * i AS VARCHAR) AS external_id, title FROM b, range({_RECYCLED}) t(i)
""")
def recycle_corpus(spark: SparkSession, root: str) -> DataFrame:
    """The songs five times over, under new ids."""
    rows = table(spark, root, "lyrics_sample").select("song_id", F.coalesce("external_id", F.lit("")).alias("external_id"), "title")
    return metrics.recycled(rows, ["song_id"], _RECYCLED * rows.count()).select("external_id", "title")


@query("""
SELECT format, count(*) AS songs, CAST(sum(length(lyrics)) AS BIGINT) AS characters
FROM lyrics_sample, (VALUES ('jsonl'), ('csv'), ('parquet')) f(format) GROUP BY format
""")
def songs_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Rows and characters of the songs as read back from JSON, CSV and Parquet files."""
    rows = table(spark, root, "lyrics_sample").select("song_id", "external_id", "title", "artist", "lyrics")
    out = None
    for ending in ("jsonl", "csv", "parquet"):
        path = new_path(spark, "songs") + "." + ending
        if ending == "jsonl":
            rows.write.json(path)
        elif ending == "csv":
            rows.write.csv(path, header=True, escape='"', quote='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        else:
            rows.write.parquet(path)
        back = songs.map_columns(songs.read_table(spark, path))
        told = back.agg(F.count(F.lit(1)).alias("songs"), F.sum(F.length("lyrics")).alias("characters"))
        told = told.withColumn("format", F.lit(ending))
        out = told if out is None else out.unionByName(told)
    return out


def _feature_table(spark: SparkSession, root: str) -> str:
    """A CSV of window features: the embeddings as windows of tracks of five, some of them broken."""
    from kelpline.functions.audio import FEATURES

    rows = table(spark, root, "embeddings")
    name = F.concat(F.lit("genre."), F.lpad(F.expr("cast(vec_id div 5 as string)"), 5, "0"), F.lit("."), (F.col("vec_id") % 5).cast("string"), F.lit(".wav"))
    broken = F.col("vec_id") % 50 == 7
    told = [F.when(broken & F.lit(i == 3), F.lit("none")).otherwise(F.col("embedding")[i].cast("string")).alias(f) for i, f in enumerate(FEATURES)]
    path = new_path(spark, "features") + ".csv"
    rows.select(name.alias("filename"), F.col("label").cast("string").alias("label"), *told).write.csv(path, header=True)
    return path


@query("""
SELECT 'genre.' || lpad(CAST(vec_id // 5 AS VARCHAR), 5, '0') || '.wav' AS track, CAST(arg_min(label, vec_id) AS VARCHAR) AS label, count(*) AS n_windows,
round(sum(embedding[1]::DOUBLE), 4) AS first_feature, round(sum(embedding[57]::DOUBLE), 4) AS last_feature
FROM embeddings WHERE vec_id % 50 <> 7 GROUP BY vec_id // 5
""")
def audio_tracks(spark: SparkSession, root: str) -> DataFrame:
    """Tracks of a CSV of window features: names, labels, windows without broken ones."""
    found = media.load_audio_features(spark, _feature_table(spark, root))
    part = lambda i: F.round(F.aggregate("features", F.lit(0.0), lambda s, w: s + w[i].cast("double")), 4)
    return found.select("track", "label", "n_windows", part(0).alias("first_feature"), part(56).alias("last_feature"))


@query("""
SELECT external_id, nullif(metadata ->> '$.articleType', '') AS type, nullif(metadata ->> '$.baseColour', '') AS color FROM items
WHERE modality = 'image' AND external_id IS NOT NULL AND external_id <> ''
""")
def style_table(spark: SparkSession, root: str) -> DataFrame:
    """Types and colours of products, written as a style table and read back."""
    get = lambda k: F.get_json_object("metadata", f"$.{k}")
    rows = table(spark, root, "items").where("modality = 'image' AND external_id <> ''")
    path = new_path(spark, "styles") + ".csv"
    rows.select(F.col("external_id").alias("id"), get("articleType").alias("articleType"), get("baseColour").alias("baseColour")).write.csv(path, header=True)
    return media.load_styles(spark, path)


@query("""
SELECT event_type, date_trunc('day', ts) AS day, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS var, count(*) AS n
FROM events GROUP BY ALL
""")
def window_features(spark: SparkSession, root: str) -> DataFrame:
    """Mean and population variance per window, the pair every spectral feature has."""
    rows = table(spark, root, "events")
    return rows.groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_pop("value"), 6).alias("var"), F.count(F.lit(1)).alias("n")
    )


@query("""
WITH c AS (SELECT item_id, TRY_CAST(metadata ->> '$.n_windows' AS BIGINT) AS w FROM items WHERE modality = 'audio'),
n AS (SELECT item_id, w, w * 66150 - 40000 AS samples FROM c WHERE w > 0)
SELECT item_id, CASE WHEN samples <= 66150 THEN 1 ELSE (samples // 66150) + CASE WHEN samples % 66150 >= 11025 THEN 1 ELSE 0 END END AS n_windows FROM n
""")
def audio_windows(spark: SparkSession, root: str) -> DataFrame:
    """Number of three-second windows of clips whose last window is a fragment."""
    from kelpline.functions.audio import window_bounds

    rows = table(spark, root, "items").where("modality = 'audio'")
    w = F.expr("try_cast(get_json_object(metadata, '$.n_windows') as bigint)")
    rows = rows.select("item_id", (w * 66150 - 40000).alias("samples"), w.alias("w")).where("w > 0")
    return rows.select("item_id", F.size(window_bounds(F.col("samples"))).cast("long").alias("n_windows"))


# -- text index --------------------------------------------------------------------------------------

_CHUNKS = rf"""
WITH s AS (SELECT song_id, regexp_replace(lyrics, {_WS}, '', 'g') AS t FROM lyrics_sample WHERE lyrics IS NOT NULL),
p AS (SELECT song_id, list_filter(list_transform(regexp_split_to_array(t, '\n\s*\n+'), lambda x: regexp_replace(x, {_WS}, '', 'g')),
      lambda x: length(x) >= 1) AS ps FROM s),
c0 AS (SELECT song_id AS item_id, unnest(range(len(ps))) AS position, unnest(ps) AS content FROM p),
c AS (SELECT row_number() OVER (ORDER BY item_id, position) - 1 AS chunk_id, * FROM c0)
"""
_INDEX = (
    _CHUNKS
    + f""",
tl AS (SELECT chunk_id, regexp_extract_all(lower(content), '{_TOKEN}') AS ts FROM c),
tk AS (SELECT chunk_id, unnest(range(len(ts))) AS pos, unnest(ts) AS term FROM tl),
tr AS (SELECT * FROM tk WHERE length(term) >= 2 AND term NOT IN {_STOP}),
tf AS (SELECT chunk_id, term, count(*) AS tf, min(pos) AS pos FROM tr GROUP BY ALL),
st AS (SELECT term, CAST(sum(tf) AS BIGINT) AS freq, count(*) AS df, min(chunk_id * 10000000 + pos) AS seen FROM tf GROUP BY term),
cb AS (SELECT CAST(row_number() OVER (ORDER BY freq DESC, seen) - 1 AS INTEGER) AS word_idx, term, freq, df,
       log10((SELECT count(*) FROM c) / df) AS idf FROM st QUALIFY word_idx < {K}),
wt AS (SELECT chunk_id, word_idx, ln(1 + tf) * idf AS w FROM tf JOIN cb USING (term)),
po AS (SELECT chunk_id, word_idx, w / nullif(sqrt(sum(w * w) OVER (PARTITION BY chunk_id)), 0) AS weight FROM wt),
post AS (SELECT * FROM po WHERE weight <> 0),
norms AS (SELECT chunk_id, sqrt(sum(weight * weight)) AS norm FROM post GROUP BY chunk_id)
"""
)


def song_items(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "lyrics_sample")
    return rows.select(F.col("song_id").alias("item_id"), "external_id", "title", "artist", "lyrics")


def song_index(spark: SparkSession, root: str, analyzer: Analyzer = PLAIN) -> index.Index:
    return index.build_text_index(song_items(spark, root), K, analyzer)


@query(_CHUNKS + "SELECT item_id, CAST(position AS INTEGER) AS position, content FROM c")
def paragraph_split(spark: SparkSession, root: str) -> DataFrame:
    return paragraph_chunks(song_items(spark, root), "item_id", "lyrics")


@query(_INDEX + "SELECT term, freq, df FROM st")
def term_frequencies(spark: SparkSession, root: str) -> DataFrame:
    chunks = paragraph_chunks(song_items(spark, root), "item_id", "lyrics")
    terms = PLAIN.exploded(chunks, "content", "item_id", "position").withColumn("chunk_id", F.struct("item_id", "position"))
    return cb.term_statistics(terms).select("term", "freq", "df")


@query(_INDEX + "SELECT word_idx, term, freq, df, round(idf, 6) AS idf FROM cb")
def text_codebook(spark: SparkSession, root: str) -> DataFrame:
    words = index.text_words(song_items(spark, root), K, PLAIN)
    return words.select("word_idx", "term", "freq", "df", F.round("idf", 6).alias("idf"))


@query(_INDEX + "SELECT chunk_id, word_idx, round(weight, 6) AS weight FROM post")
def tfidf_histogram(spark: SparkSession, root: str) -> DataFrame:
    return song_index(spark, root).postings.select("chunk_id", "word_idx", F.round("weight", 6).alias("weight"))


@query(_INDEX + "SELECT chunk_id, round(norm, 6) AS norm FROM norms")
def histogram_norms(spark: SparkSession, root: str) -> DataFrame:
    return song_index(spark, root).norms.select("chunk_id", F.round("norm", 6).alias("norm"))


@query(_INDEX + "SELECT count(DISTINCT word_idx) AS n_terms, count(*) AS n_postings, count(DISTINCT chunk_id) AS n_chunks FROM post")
def inverted_index_stats(spark: SparkSession, root: str) -> DataFrame:
    postings = song_index(spark, root).postings
    return postings.agg(
        F.countDistinct("word_idx").alias("n_terms"), F.count(F.lit(1)).alias("n_postings"), F.countDistinct("chunk_id").alias("n_chunks")
    )


@query(_INDEX + "SELECT word_idx, chunk_id // 4096 AS part, array_to_string(list(chunk_id ORDER BY chunk_id), ' ') AS chunks FROM post GROUP BY ALL")
def posting_lists(spark: SparkSession, root: str) -> DataFrame:
    lists = index.posting_lists(song_index(spark, root).postings)
    return lists.select("word_idx", "part", F.array_join(F.transform("postings", lambda p: p["chunk_id"].cast("string")), " ").alias("chunks"))


def _asked(source: str) -> str:
    """SQL of query histograms q(query_id, word_idx, w) of the rows (query_id, text) of ``source``."""
    return f""",
qs AS ({source}),
qt AS (SELECT query_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS term FROM qs),
qf AS (SELECT query_id, word_idx, ln(1 + count(*)) * idf AS w FROM qt JOIN cb USING (term) GROUP BY query_id, word_idx, idf),
qn AS (SELECT query_id, word_idx, w / nullif(sqrt(sum(w * w) OVER (PARTITION BY query_id)), 0) AS w FROM qf),
ql AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qn GROUP BY query_id),
sc AS (SELECT query_id, chunk_id, sum(w * weight) / any_value(norm) / any_value(ql.n) AS score
       FROM qn JOIN post USING (word_idx) JOIN norms USING (chunk_id) JOIN ql USING (query_id) GROUP BY query_id, chunk_id)
"""


_ONE = _INDEX + _asked(f"SELECT 0 AS query_id, '{PHRASE}' AS text")
_BATCH = _INDEX + _asked("SELECT item_id AS query_id, passage AS text FROM eval_items WHERE passage IS NOT NULL")
_TOP = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS place FROM sc"
_ITEMS = """,
top AS ({top} QUALIFY place <= {fetch}),
best AS (SELECT query_id, item_id, chunk_id, score, content FROM top JOIN c USING (chunk_id)
         QUALIFY row_number() OVER (PARTITION BY query_id, item_id ORDER BY round(score, 6) DESC, chunk_id) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, item_id) AS place FROM best)
"""


@query(_ONE + f"SELECT chunk_id, round(score, 4) AS score, CAST(place AS INTEGER) AS place FROM ({_TOP}) WHERE place <= 10")
def search_text_chunks(spark: SparkSession, root: str) -> DataFrame:
    ix = song_index(spark, root)
    hits = search.search_chunks(ix, search.quantise_text(ix, query_frame(spark, PHRASE)), 10)
    return hits.select("chunk_id", F.round("score", 4).alias("score"), "place")


@query(
    _ONE + _ITEMS.format(top=_TOP, fetch=50) + "SELECT item_id, chunk_id, content, title, artist, round(score, 4) AS score,"
    " CAST(place AS INTEGER) AS place FROM ranked JOIN lyrics_sample ON song_id = item_id WHERE place <= 10"
)
def search_text_items(spark: SparkSession, root: str) -> DataFrame:
    found = search.search_text_items(song_index(spark, root), query_frame(spark, PHRASE), 10)
    return found.select("item_id", "chunk_id", "content", "title", "artist", "score", "place")


def _passages(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "eval_items").where("passage is not null")
    return rows.select(F.col("item_id").alias("query_id"), F.col("passage").alias("text"))


@query(_BATCH + f"SELECT query_id, chunk_id, round(score, 4) AS score, CAST(place AS INTEGER) AS place FROM ({_TOP}) WHERE place <= 10")
def batch_search(spark: SparkSession, root: str) -> DataFrame:
    """All evaluation passages as queries against all paragraphs, in one join."""
    ix = song_index(spark, root)
    hits = search.search_chunks(ix, search.quantise_text(ix, _passages(spark, root)), 10)
    return hits.select("query_id", "chunk_id", F.round("score", 4).alias("score"), "place")


@query(
    _BATCH + _ITEMS.format(top=_TOP, fetch=25) + "SELECT query_id, item_id, round(score, 4) AS score, CAST(place AS INTEGER) AS place FROM ranked WHERE place <= 5"
)
def batch_search_items(spark: SparkSession, root: str) -> DataFrame:
    found = search.search_text_items(song_index(spark, root), _passages(spark, root), 5)
    return found.select("query_id", "item_id", "score", "place")


@query(
    _ONE + """,
b AS (SELECT query_id, item_id, max(score) AS s FROM sc JOIN c USING (chunk_id) GROUP BY ALL),
r AS (SELECT item_id, s, row_number() OVER (ORDER BY round(s, 6) DESC, item_id) AS place FROM b)
SELECT item_id, round(s, 4) AS score, round(1 - s, 6) AS dist, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10
"""
)
def dense_text_items(spark: SparkSession, root: str) -> DataFrame:
    """Least distance over all chunks of an item, without a cut before the rollup."""
    ix = song_index(spark, root)
    found = knn.dense_items(ix, search.quantise_text(ix, query_frame(spark, PHRASE)), 10)
    return found.select("item_id", "score", F.round("dist", 6).alias("dist"), "place")


@query(_BATCH + "SELECT query_id, CAST(sum(df) AS BIGINT) AS visited FROM qn JOIN (SELECT word_idx, count(*) AS df FROM post GROUP BY 1) USING (word_idx) GROUP BY 1")
def postings_visited(spark: SparkSession, root: str) -> DataFrame:
    ix = song_index(spark, root)
    return search.postings_visited(search.quantise_text(ix, _passages(spark, root)), ix.postings)


@query()
def search_stemmed(spark: SparkSession, root: str) -> DataFrame:
    """The same search over stems."""
    ix = song_index(spark, root, Analyzer(stem=True))
    return search.search_text_items(ix, query_frame(spark, PHRASE), 10).drop("query_id")


@query()
def generated_queries(spark: SparkSession, root: str) -> DataFrame:
    return metrics.generated_queries(index.text_words(song_items(spark, root), K, PLAIN), 30)


_FULL = f"""
WITH tk AS (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '{_TOKEN}')) AS term FROM (SELECT DISTINCT chunk_id, content FROM chunks WHERE modality = 'text' AND content IS NOT NULL)),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tk WHERE length(term) >= 2 AND term NOT IN {_STOP} GROUP BY ALL),
q AS (SELECT DISTINCT query_id, term FROM (SELECT 0 AS query_id, unnest(regexp_extract_all(lower('{PHRASE}'), '{_TOKEN}')) AS term
      UNION ALL SELECT 1, unnest(['copper', 'moon'])) WHERE length(term) >= 2 AND term NOT IN {_STOP}),
nq AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1),
m AS (SELECT query_id, chunk_id, sum(ln(1 + tf)) / any_value(n) AS rank FROM q JOIN tf USING (term) JOIN nq USING (query_id)
      GROUP BY query_id, chunk_id HAVING count(*) = any_value(n))
"""


def _matches(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    chunks = table(spark, root, "chunks").where("modality = 'text' and content is not null")
    chunks = chunks.select("chunk_id", "item_id", "content").distinct()
    postings = fulltext.term_postings(chunks, "content", PLAIN, "chunk_id")
    return fulltext.match_all(postings, query_frame(spark, PHRASE, "the copper moon"), PLAIN), chunks


@query(_FULL + "SELECT query_id, chunk_id, round(rank, 6) AS rank FROM m")
def fulltext_and(spark: SparkSession, root: str) -> DataFrame:
    return _matches(spark, root)[0].select("query_id", "chunk_id", F.round("rank", 6).alias("rank"))


@query(
    _FULL + """, i AS (SELECT query_id, item_id, max(rank) AS rank FROM m JOIN (SELECT DISTINCT chunk_id, item_id FROM chunks) USING (chunk_id) GROUP BY ALL)
SELECT query_id, item_id, round(rank, 6) AS rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 6) DESC, item_id) AS INTEGER) AS place
FROM i QUALIFY place <= 10
"""
)
def fulltext_items(spark: SparkSession, root: str) -> DataFrame:
    matches, chunks = _matches(spark, root)
    return fulltext.best_items(matches, chunks, 10).select("query_id", "item_id", F.round("rank", 6).alias("rank"), "place")


# -- dense vectors -----------------------------------------------------------------------------------

_KNN = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
d AS (SELECT a.vec_id AS query_id, b.vec_id, 1 - list_cosine_similarity(a.v, b.v) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 6), vec_id) AS place FROM d)
"""


def _nearest(spark: SparkSession, root: str, k: int, every: int = EVERY) -> DataFrame:
    rows = table(spark, root, "embeddings")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return knn.exact(rows, asked, k, "vec_id", "embedding")


@query(_KNN.format(every=EVERY) + "SELECT query_id, vec_id, round(dist, 6) AS dist, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10")
def knn_exact(spark: SparkSession, root: str) -> DataFrame:
    return _nearest(spark, root, 10).select("query_id", "vec_id", F.round("dist", 6).alias("dist"), "place")


@query(
    _KNN.format(every=EVERY) + """, h AS (SELECT * FROM r WHERE place <= 40),
i AS (SELECT query_id, vec_id // 5 AS item_id, min(dist) AS dist FROM h GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 6), item_id) AS place FROM i)
SELECT query_id, item_id, round(1 - dist, 4) AS score, CAST(place AS INTEGER) AS place FROM o WHERE place <= 10
"""
)
def knn_item_min(spark: SparkSession, root: str) -> DataFrame:
    """Four times as many chunks as wanted items; five consecutive vectors are one item."""
    chunks = table(spark, root, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.expr("vec_id div 5").alias("item_id"))
    hits = _nearest(spark, root, 40).withColumnRenamed("vec_id", "chunk_id")
    return knn.items_of_chunks(hits, chunks, 10).select("query_id", "item_id", "score", "place")


_STORED = """
WITH h AS (SELECT DISTINCT chunk_id, hist::DOUBLE[] AS v FROM histograms WHERE modality = '{m}' AND hist IS NOT NULL),
u AS (SELECT * FROM h WHERE len(list_filter(v, lambda x: isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT * FROM u ORDER BY chunk_id LIMIT 1)
SELECT u.chunk_id, round(1 - list_cosine_similarity(u.v, p.v), 6) AS dist FROM u, p WHERE u.chunk_id <> p.chunk_id
ORDER BY round(1 - list_cosine_similarity(u.v, p.v), 6), u.chunk_id LIMIT 10
"""


def _stored(spark: SparkSession, root: str, modality: str) -> DataFrame:
    rows = table(spark, root, "histograms").where(F.col("modality") == modality)
    return rows.groupBy("chunk_id").agg(F.max("hist").alias("hist")).where(vx.usable(F.col("hist")))


def _example(spark: SparkSession, root: str, modality: str) -> DataFrame:
    rows = materialize(_stored(spark, root, modality), "stored")
    probe = rows.agg(F.min("chunk_id").alias("id")).first()["id"]
    return knn.by_example(rows, probe, 10, "chunk_id", "hist").select("chunk_id", F.round("dist", 6).alias("dist"))


@query(_STORED.format(m="image"))
def knn_by_example_image(spark: SparkSession, root: str) -> DataFrame:
    return _example(spark, root, "image")


@query(_STORED.format(m="audio"))
def knn_by_example_audio(spark: SparkSession, root: str) -> DataFrame:
    return _example(spark, root, "audio")


#: Cells that a search of the approximate index looks into.
DEPTHS = (1, 2, 4, 8)


def _cells(spark: SparkSession, root: str) -> tuple[knn.CellIndex, DataFrame, DataFrame]:
    """A stored index of the audio histograms, the vectors, and every hundredth of them as a query."""
    rows = materialize(_stored(spark, root, "audio"), "stored")
    asked = rows.where(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("query_id"), "hist")
    return knn.build_cells(rows, "chunk_id", "hist", new_path(spark, "cells")), rows, asked


@query()
def ann_cells(spark: SparkSession, root: str) -> DataFrame:
    """Neighbours of every hundredth embedding from the eight nearest cells of a stored index, loaded again."""
    rows = table(spark, root, "embeddings")
    asked = rows.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    built = knn.build_cells(rows, "vec_id", "embedding", new_path(spark, "cells"))
    found = knn.search_cells(knn.load_cells(spark, built.path), asked, 10, 8, "embedding", "vec_id")
    return found.withColumn("dist", F.round("dist", 6))


@query()
def ann_recall(spark: SparkSession, root: str) -> DataFrame:
    """Mean recall of the index against the exact neighbours and the share of vectors compared, by depth."""
    built, rows, asked = _cells(spark, root)
    exact = materialize(knn.exact(rows, asked, 10, "chunk_id", "hist"), "exact")
    out = None
    for depth in DEPTHS:
        found = knn.search_cells(built, asked, 10, depth, "hist", "chunk_id")
        told = metrics.recall(exact, found, "chunk_id").agg(F.round(F.avg("recall"), 4).alias("recall"))
        told = told.join(F.broadcast(knn.compared_share(built, asked, depth, "hist").select(F.round("share", 4).alias("compared"))))
        told = told.withColumn("depth", F.lit(depth))
        out = told if out is None else out.unionByName(told)
    return out


_NEAREST_AUDIO = """
WITH h AS (SELECT DISTINCT chunk_id, hist::DOUBLE[] AS v FROM histograms WHERE modality = 'audio' AND hist IS NOT NULL),
u AS (SELECT * FROM h WHERE len(list_filter(v, lambda x: isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
d AS (SELECT a.chunk_id AS query_id, b.chunk_id, 1 - list_cosine_similarity(a.v, b.v) AS dist FROM u a JOIN u b ON a.chunk_id <> b.chunk_id WHERE a.chunk_id % 100 = 0)
SELECT query_id, chunk_id, round(dist, 6) AS dist, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 6), chunk_id) AS INTEGER) AS place
FROM d QUALIFY place <= 10
"""


@query(_NEAREST_AUDIO)
def ann_exhaustive(spark: SparkSession, root: str) -> DataFrame:
    """The index at full depth gives the exact neighbours."""
    built, _, asked = _cells(spark, root)
    found = knn.search_cells(built, asked, 10, built.centres.count(), "hist", "chunk_id")
    return found.select("query_id", "chunk_id", F.round("dist", 6).alias("dist"), "place")


# -- vector codebooks --------------------------------------------------------------------------------

_Z = """
WITH x AS (SELECT vec_id, label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
z AS (SELECT dim, avg(x) AS mean, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1.0 END AS scale FROM x GROUP BY dim),
s AS (SELECT vec_id, label, dim, (x - mean) / scale AS x FROM x JOIN z USING (dim))
"""
_ASSIGN = (
    _Z
    + """,
cd AS (SELECT CAST(label AS INTEGER) AS word_idx, dim, avg(x) AS c FROM s GROUP BY ALL),
half AS (SELECT word_idx, sum(c * c) / 2 AS h FROM cd GROUP BY word_idx),
sm AS (SELECT vec_id, word_idx, sum(x * c) - any_value(h) AS sim FROM s JOIN cd USING (dim) JOIN half USING (word_idx) GROUP BY ALL),
a AS (SELECT vec_id, vec_id // 5 AS item_id, word_idx FROM sm
      QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, word_idx) = 1),
idf AS (SELECT h.word_idx, coalesce(df, 0) AS df, log10((SELECT count(DISTINCT item_id) FROM a) / greatest(coalesce(df, 0), 1)) AS idf
        FROM half h LEFT JOIN (SELECT word_idx, count(DISTINCT item_id) AS df FROM a GROUP BY 1) d USING (word_idx)),
bow AS (SELECT item_id, word_idx, count(*) AS tf FROM a GROUP BY ALL),
vw AS (SELECT item_id, word_idx, ln(1 + tf) * idf AS w FROM bow JOIN idf USING (word_idx)),
vp AS (SELECT item_id, word_idx, w / nullif(sqrt(sum(w * w) OVER (PARTITION BY item_id)), 0) AS weight FROM vw),
vpost AS (SELECT * FROM vp WHERE weight <> 0)
"""
)


def _descriptors(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select(
        "vec_id", F.expr("vec_id div 5").alias("item_id"), "label", F.col("embedding").cast("array<double>").alias("vec")
    )


def _label_means(scaled: DataFrame) -> DataFrame:
    rows = scaled.select(F.col("label").cast("int").alias("word_idx"), F.posexplode("vec").alias("dim", "x"))
    means = rows.groupBy("word_idx", "dim").agg(F.avg("x").alias("c"))
    packed = means.groupBy("word_idx").agg(F.array_sort(F.collect_list(F.struct("dim", "c"))).alias("v"))
    return packed.select("word_idx", F.col("v.c").alias("vec"))


def _assigned(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Descriptors with their nearest centroid, and the centroids: means of the labels' standardised vectors."""
    rows = _descriptors(spark, root)
    scaled = materialize(cb.z_apply(rows, cb.z_fit(rows)), "scaled")
    centroids = materialize(_label_means(scaled), "centroids")
    return cb.assign(scaled, centroids), centroids


@query(_Z + "SELECT CAST(dim AS INTEGER) AS dim, round(mean, 6) AS mean, round(scale, 6) AS scale FROM z")
def zscore_fit(spark: SparkSession, root: str) -> DataFrame:
    fitted = cb.z_fit(_descriptors(spark, root))
    return fitted.select("dim", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


@query(_Z + "SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(x, 6) AS x FROM s")
def zscore_apply(spark: SparkSession, root: str) -> DataFrame:
    rows = _descriptors(spark, root)
    return cb.z_apply(rows, cb.z_fit(rows)).select("vec_id", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query(_ASSIGN + "SELECT vec_id, word_idx FROM a")
def assign_centroid(spark: SparkSession, root: str) -> DataFrame:
    return _assigned(spark, root)[0].select("vec_id", "word_idx")


@query(_ASSIGN + "SELECT item_id, word_idx, tf FROM bow")
def bow_histogram(spark: SparkSession, root: str) -> DataFrame:
    return _assigned(spark, root)[0].groupBy("item_id", "word_idx").agg(F.count(F.lit(1)).alias("tf"))


@query(_ASSIGN + "SELECT word_idx, df, round(idf, 6) AS idf FROM idf")
def visual_idf(spark: SparkSession, root: str) -> DataFrame:
    assigned, centroids = _assigned(spark, root)
    return cb.visual_idf(assigned, centroids).select("word_idx", F.col("df").cast("long").alias("df"), F.round("idf", 6).alias("idf"))


def _vector_index(spark: SparkSession, root: str, colour: bool = False) -> index.Index:
    """Items of five vectors; the first numbers of their first vector play the colours."""
    rows = _descriptors(spark, root)
    scaled = materialize(cb.z_apply(rows, cb.z_fit(rows)), "scaled")
    packed = rows.groupBy("item_id").agg(
        F.array_sort(F.collect_list(F.struct("vec_id", "vec", "label"))).alias("r")
    )
    items = packed.select(
        "item_id", F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("filename"), F.col("r.vec").alias("descriptors"),
        F.col("r.label")[0].alias("label"), vx.l2_normalised(F.slice(F.col("r.vec")[0], 1, 8)).alias("colour"),
    )
    items = materialize(items, "items")
    return index.build_vector_index(items, "image", 10, "descriptors", "colour" if colour else None, centroids=_label_means(scaled))


@query(_ASSIGN + "SELECT item_id, word_idx, round(weight, 6) AS weight FROM vpost")
def vector_histograms(spark: SparkSession, root: str) -> DataFrame:
    postings = _vector_index(spark, root).postings
    return postings.select(F.col("chunk_id").alias("item_id"), "word_idx", F.round("weight", 6).alias("weight"))


_FUSED = (
    _ASSIGN
    + """,
f AS (SELECT vec_id // 5 AS item_id, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS v FROM embeddings
      QUALIFY row_number() OVER (PARTITION BY vec_id // 5 ORDER BY vec_id) = 1),
fx AS (SELECT item_id, CAST(unnest(range(8)) AS INTEGER) AS dim, unnest(v) / sqrt(list_sum(list_transform(v, lambda x: x * x))) AS x FROM f),
fused AS (SELECT item_id, word_idx, weight * sqrt(0.5) AS weight FROM vpost
          UNION ALL SELECT item_id, CAST(10 + dim AS INTEGER), x * sqrt(0.5) FROM fx WHERE x <> 0)
"""
)


@query(_FUSED + "SELECT item_id, word_idx, round(weight, 6) AS weight FROM fused")
def fuse_colour(spark: SparkSession, root: str) -> DataFrame:
    postings = _vector_index(spark, root, colour=True).postings
    return postings.select(F.col("chunk_id").alias("item_id"), "word_idx", F.round("weight", 6).alias("weight"))


@query(_FUSED + ", n AS (SELECT item_id, sqrt(sum(weight * weight)) AS n FROM fused GROUP BY 1)," """
sc AS (SELECT a.item_id AS query_id, b.item_id, sum(a.weight * b.weight) / any_value(na.n) / any_value(nb.n) AS score
  FROM fused a JOIN fused b ON a.word_idx = b.word_idx AND a.item_id <> b.item_id JOIN n na ON na.item_id = a.item_id
  JOIN n nb ON nb.item_id = b.item_id WHERE a.item_id % 100 = 0 GROUP BY ALL)
SELECT query_id, item_id, round(score, 4) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, item_id) AS INTEGER) AS place
FROM sc QUALIFY place <= 10
""")
def search_from_hist(spark: SparkSession, root: str) -> DataFrame:
    """Stored histograms of every hundredth item as queries; an item does not find itself."""
    ix = _vector_index(spark, root, colour=True)
    asked = ix.postings.where(F.col("chunk_id") % EVERY == 0)
    asked = asked.select(F.col("chunk_id").alias("query_id"), "word_idx", "weight")
    own = asked.select("query_id", F.col("query_id").alias("chunk_id")).distinct()
    return search.search_histograms(ix, asked, 10, exclude=own).select("query_id", "item_id", "score", "place")


@query(_ASSIGN + """, n AS (SELECT item_id, sqrt(sum(weight * weight)) AS n FROM vpost GROUP BY 1),
sc AS (SELECT a.item_id AS query_id, b.item_id, sum(a.weight * b.weight) / any_value(na.n) / any_value(nb.n) AS score
  FROM vpost a JOIN vpost b ON a.word_idx = b.word_idx JOIN n na ON na.item_id = a.item_id JOIN n nb ON nb.item_id = b.item_id
  WHERE a.item_id % 100 = 0 GROUP BY ALL),
l AS (SELECT vec_id // 5 AS item_id, arg_min(label, vec_id) AS label FROM embeddings GROUP BY 1)
SELECT query_id, item_id, 'item-' || CAST(item_id AS VARCHAR) AS filename, label, round(score, 4) AS score,
CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, item_id) AS INTEGER) AS place
FROM sc JOIN l USING (item_id) QUALIFY place <= 10
""")
def search_descriptors(spark: SparkSession, root: str) -> DataFrame:
    """Raw descriptors of every hundredth item as queries, through scaler, codebook and index."""
    ix = _vector_index(spark, root)
    asked = _descriptors(spark, root).where(F.col("item_id") % EVERY == 0)
    asked = asked.groupBy(F.col("item_id").alias("query_id")).agg(F.collect_list("vec").alias("descriptors"))
    found = search.search_histograms(ix, search.quantise_descriptors(ix, asked), 10)
    return found.select("query_id", "item_id", "filename", "label", "score", "place")


@query(_ASSIGN + """, top AS (SELECT item_id, array_to_string(list_transform(range(10), lambda i:
  coalesce(round(list_sum(list_filter(ws, lambda w: w.word_idx = i).list_transform(lambda w: w.weight)), 6), 0.0)), ' ') AS hist
  FROM (SELECT item_id, list({'word_idx': word_idx, 'weight': weight}) AS ws FROM vpost GROUP BY item_id)) SELECT * FROM top""")
def densify(spark: SparkSession, root: str) -> DataFrame:
    ix = _vector_index(spark, root)
    dense = hg.dense_of_sparse(ix.postings.withColumnRenamed("chunk_id", "item_id"), "item_id", ix.hist_dim)
    return dense.select("item_id", F.array_join(F.transform("hist", lambda x: F.round(x, 6).cast("string")), " ").alias("hist"))


@query(_ASSIGN + "SELECT word_idx, round(weight, 6) AS weight FROM vpost WHERE item_id = 7")
def item_histogram(spark: SparkSession, root: str) -> DataFrame:
    return hg.of_chunk(_vector_index(spark, root).postings, 7).select("word_idx", F.round("weight", 6).alias("weight"))


@query(
    """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS w, v FROM v QUALIFY w < 10),
a0 AS (SELECT vec_id, v.v AS v, arg_max(w, round(list_dot_product(v.v, c0.v) - list_dot_product(c0.v, c0.v) / 2, 9) * 1000 - w * 1e-9) AS w FROM v, c0 GROUP BY ALL),
c1 AS (SELECT w, list(m ORDER BY d) AS v FROM (SELECT w, d, avg(x) AS m FROM (SELECT w, unnest(range(len(v))) AS d, unnest(v) AS x FROM a0) GROUP BY ALL) GROUP BY w),
a1 AS (SELECT vec_id, v.v AS v, arg_max(w, round(list_dot_product(v.v, c1.v) - list_dot_product(c1.v, c1.v) / 2, 9) * 1000 - w * 1e-9) AS w FROM v, c1 GROUP BY ALL),
c2 AS (SELECT w, d, avg(x) AS m FROM (SELECT w, unnest(range(len(v))) AS d, unnest(v) AS x FROM a1) GROUP BY ALL)
SELECT w AS word_idx, CAST(d AS INTEGER) AS dim, round(m, 6) AS x FROM c2
"""
)
def lloyd_kmeans(spark: SparkSession, root: str) -> DataFrame:
    """Two rounds from the first ten vectors."""
    rows = _descriptors(spark, root)
    first = songs.dense_ids(rows.orderBy("vec_id").limit(10), ["vec_id"], "n")
    moved = cb.lloyd(rows, first.select(F.col("n").cast("int").alias("word_idx"), "vec"), 2)
    return moved.select("word_idx", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query()
def kmeans_trained(spark: SparkSession, root: str) -> DataFrame:
    """Members and mean squared distance of trained centroids."""
    rows = _descriptors(spark, root)
    scaled = materialize(cb.z_apply(rows, cb.z_fit(cb.descriptor_sample(rows, ["vec_id"], 500_000))), "scaled")
    centroids = cb.k_means(scaled, 32, seed=1)
    placed = cb.assign(scaled, centroids).join(F.broadcast(centroids.withColumnRenamed("vec", "c")), "word_idx")
    apart = F.zip_with("vec", "c", lambda a, b: a - b)
    return placed.groupBy("word_idx").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(vx.norm(apart) * vx.norm(apart)), 6).alias("mean_square")
    )


# -- query language ----------------------------------------------------------------------------------


@query(
    _ONE + _ITEMS.format(top=_TOP, fetch=25) + "SELECT title, artist, round(score, 4) AS score FROM ranked"
    " JOIN lyrics_sample ON song_id = item_id WHERE place <= 5"
)
def mini_sql_projection(spark: SparkSession, root: str) -> DataFrame:
    text = f"select title, artist, nothing from Songs where lyrics <-> '{PHRASE}' limit 5"
    return planner.run(text, {"text": song_index(spark, root)})


@query(
    _ONE + _ITEMS.format(top=_TOP, fetch=50) + "SELECT item_id, chunk_id, content, external_id, title, artist,"
    " round(score, 4) AS score, CAST(place AS INTEGER) AS place FROM ranked JOIN lyrics_sample ON song_id = item_id WHERE place <= 10"
)
def mini_sql_text(spark: SparkSession, root: str) -> DataFrame:
    return planner.run(f"SELECT * FROM lyrics WHERE lyrics @@ '{PHRASE}'", {"text": song_index(spark, root)})


_MEDIA = """
WITH h AS (SELECT DISTINCT chunk_id, hist::DOUBLE[] AS v FROM histograms WHERE modality = '{m}' AND hist IS NOT NULL),
u AS (SELECT * FROM h WHERE len(list_filter(v, lambda x: isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
ic AS (SELECT DISTINCT chunk_id, item_id FROM chunks WHERE modality = '{m}'),
f AS (SELECT item_id, min(external_id) AS filename FROM items WHERE modality = '{m}' GROUP BY 1),
j AS (SELECT u.chunk_id, v, ic.item_id, filename FROM u JOIN ic USING (chunk_id) JOIN f USING (item_id)),
p AS (SELECT chunk_id, v FROM j ORDER BY item_id, chunk_id LIMIT 1),
s AS (SELECT j.item_id, j.chunk_id, filename, list_cosine_similarity(j.v, p.v) AS score FROM j, p WHERE j.chunk_id <> p.chunk_id)
SELECT filename, round(score, 4) AS score FROM s WHERE score > 0 ORDER BY round(score, 6) DESC, chunk_id LIMIT 7
"""


def _media(spark: SparkSession, root: str, modality: str, collection: str) -> DataFrame:
    chunks = table(spark, root, "chunks").where(F.col("modality") == modality).select("chunk_id", "item_id").distinct()
    items = table(spark, root, "items").where(F.col("modality") == modality)
    items = items.groupBy("item_id").agg(F.min("external_id").alias("filename"))
    rows = materialize(_stored(spark, root, modality), "stored")
    ix = index.index_of_histograms(rows, "chunk_id", "hist", modality, items, chunks)
    first = chunks.join(rows.select("chunk_id"), "chunk_id", "left_semi").join(items, "item_id").orderBy("item_id").limit(1).first()
    name = first["filename"].replace("'", "") if first else "none"
    return planner.run(f"SELECT filename FROM {collection} WHERE filename = '{name}' LIMIT 7", {modality: ix})


@query(_MEDIA.format(m="audio"))
def mini_sql_audio(spark: SparkSession, root: str) -> DataFrame:
    return _media(spark, root, "audio", "tracks")


@query(_MEDIA.format(m="image"))
def mini_sql_image(spark: SparkSession, root: str) -> DataFrame:
    """By file name, through the stored histogram."""
    return _media(spark, root, "image", "products")


# -- metrics -----------------------------------------------------------------------------------------


@query(
    _KNN.format(every=EVERY) + """, a AS (SELECT query_id, vec_id FROM r WHERE place <= 10), b AS (SELECT query_id, vec_id FROM r WHERE place <= 5)
SELECT a.query_id, round(count(b.vec_id) / count(*), 6) AS recall FROM a LEFT JOIN b ON a.query_id = b.query_id AND a.vec_id = b.vec_id GROUP BY 1
"""
)
def recall_at_k(spark: SparkSession, root: str) -> DataFrame:
    """Five neighbours held against ten."""
    ten = materialize(_nearest(spark, root, 10), "ten")
    return metrics.recall(ten, ten.where("place <= 5"), "vec_id").select("query_id", F.round("recall", 6).alias("recall"))


@query(
    _KNN.format(every=EVERY) + """, k AS (SELECT q.label, avg(CASE WHEN q.label = x.label THEN 1.0 ELSE 0.0 END) AS c FROM r JOIN e q ON q.vec_id = r.query_id
JOIN e x ON x.vec_id = r.vec_id WHERE place <= 10 GROUP BY r.query_id, q.label)
SELECT label, round(avg(c), 6) AS coherence, count(*) AS n FROM k GROUP BY label
"""
)
def coherence_at_k(spark: SparkSession, root: str) -> DataFrame:
    labels = table(spark, root, "embeddings").select("vec_id", "label")
    told = metrics.coherence(_nearest(spark, root, 10), labels, "vec_id")
    return told.select("label", F.round("coherence", 6).alias("coherence"), "n")


@query("""
WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT round(sum(n * n) / (sum(n) * sum(n)), 6) AS chance, round(1 / count(*), 6) AS uniform FROM c
""")
def chance_baseline(spark: SparkSession, root: str) -> DataFrame:
    told = metrics.chance(table(spark, root, "embeddings"))
    return told.select(F.round("chance", 6).alias("chance"), F.round("uniform", 6).alias("uniform"))


@query("""
WITH s AS (SELECT l_returnflag, list(l_extendedprice ORDER BY l_extendedprice) AS v FROM lineitem GROUP BY 1)
SELECT l_returnflag, CAST(len(v) AS BIGINT) AS n, round(list_avg(v), 4) AS mean, v[len(v) // 2 + 1] AS p50,
v[least(len(v) - 1, CAST(floor(0.95 * len(v)) AS BIGINT)) + 1] AS p95 FROM s
""")
def latency_order_stats(spark: SparkSession, root: str) -> DataFrame:
    told = metrics.order_statistics(table(spark, root, "lineitem"), ["l_returnflag"], F.col("l_extendedprice"), 4)
    return told.drop("per_second")


_SLICES = """
WITH h AS (SELECT DISTINCT chunk_id, hist::DOUBLE[] AS v FROM histograms WHERE modality = 'image' AND hist IS NOT NULL),
u AS (SELECT * FROM h WHERE len(list_filter(v, lambda x: isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0)
SELECT chunk_id, round(sqrt(list_sum(list_transform(v[1:512], lambda x: x * x))), 5) AS shape_norm,
round(sqrt(list_sum(list_transform(v[513:544], lambda x: x * x))), 5) AS colour_norm FROM u
"""


@query(_SLICES)
def ablation_slices(spark: SparkSession, root: str) -> DataFrame:
    """Norms of the shape and the colour part of the image histograms."""
    rows = _stored(spark, root, "image")
    part = lambda a, n: F.round(vx.norm(F.slice("hist", a, n)), 5)
    return rows.select("chunk_id", part(1, 512).alias("shape_norm"), part(513, 32).alias("colour_norm"))


@query("""
WITH h AS (SELECT DISTINCT chunk_id, hist::DOUBLE[] AS v FROM histograms WHERE modality = 'image' AND hist IS NOT NULL),
u AS (SELECT * FROM h WHERE len(list_filter(v, lambda x: isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
w AS (SELECT chunk_id, 'shape' AS view, v[1:512] AS v FROM u UNION ALL SELECT chunk_id, 'colour', v[513:544] FROM u UNION ALL SELECT chunk_id, 'fused', v FROM u),
z AS (SELECT * FROM w WHERE len(list_filter(v, lambda x: x <> 0)) > 0),
i AS (SELECT item_id, min(metadata ->> '$.articleType') AS label FROM items WHERE modality = 'image' GROUP BY 1),
l AS (SELECT DISTINCT chunk_id, label FROM (SELECT DISTINCT chunk_id, item_id FROM chunks WHERE modality = 'image') JOIN i USING (item_id)),
d AS (SELECT a.view, a.chunk_id AS q, b.chunk_id AS b, row_number() OVER (PARTITION BY a.view, a.chunk_id ORDER BY round(1 - list_cosine_similarity(a.v, b.v), 6), b.chunk_id) AS place
  FROM z a JOIN z b ON a.view = b.view AND a.chunk_id <> b.chunk_id WHERE a.chunk_id % 100 = 0),
c AS (SELECT view, q, avg(CASE WHEN lq.label = lb.label THEN 1.0 ELSE 0.0 END) AS c FROM d JOIN l lq ON lq.chunk_id = q
  LEFT JOIN l lb ON lb.chunk_id = b WHERE place <= 10 AND length(lq.label) > 0 GROUP BY view, q)
SELECT view, round(avg(c), 6) AS coherence, count(*) AS queries FROM c GROUP BY view
""")
def ablation_coherence(spark: SparkSession, root: str) -> DataFrame:
    """Type coherence of ten neighbours by shape, by colour and by both, each view of unit length."""
    kind = F.get_json_object("metadata", "$.articleType").alias("label")
    items = table(spark, root, "items").where("modality = 'image'").select("item_id", kind).groupBy("item_id").agg(F.min("label").alias("label"))
    chunks = table(spark, root, "chunks").where("modality = 'image'").select("chunk_id", "item_id").distinct()
    labels = materialize(chunks.join(items, "item_id").select("chunk_id", "label"), "labels")
    rows = materialize(_stored(spark, root, "image"), "stored")
    out = None
    for view, a, n in (("shape", 1, 512), ("colour", 513, 32), ("fused", 1, 544)):
        seen = materialize(rows.select("chunk_id", vx.l2_normalised(F.slice("hist", a, n)).alias("hist")), "view")
        asked = seen.where(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("query_id"), "hist")
        told = metrics.coherence(knn.exact(seen, asked, 10, "chunk_id", "hist"), labels, "chunk_id")
        told = told.agg(F.round(F.sum(F.col("coherence") * F.col("n")) / F.sum("n"), 6).alias("coherence"), F.sum("n").alias("queries"))
        told = told.where("queries > 0").withColumn("view", F.lit(view))
        out = told if out is None else out.unionByName(told)
    return out


_COLUMNS = {"mfcc": (18, 40), "all": (1, 57)}


@query(
    _Z + ", " + """w AS (
  SELECT a.name, st.on_scale, vec_id, label, list(CASE WHEN on_scale THEN (x.x - z.mean) / z.scale ELSE x.x END ORDER BY x.dim) AS v
  FROM x JOIN z USING (dim), (VALUES ('mfcc', 17, 57), ('all', 0, 57)) a(name, lo, hi), (VALUES (TRUE), (FALSE)) st(on_scale)
  WHERE x.dim >= lo AND x.dim < hi GROUP BY ALL),
d AS (SELECT a.name, a.on_scale, a.vec_id AS q, a.label AS lq, b.label AS lb,
  row_number() OVER (PARTITION BY a.name, a.on_scale, a.vec_id ORDER BY round(1 - list_cosine_similarity(a.v, b.v), 6), b.vec_id) AS place
  FROM w a JOIN w b ON a.name = b.name AND a.on_scale = b.on_scale AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT name AS columns, on_scale AS standardised, round(avg(CASE WHEN lq = lb THEN 1.0 ELSE 0.0 END), 6) AS coherence, CAST(count(DISTINCT q) AS BIGINT) AS queries
FROM d WHERE place <= 10 GROUP BY name, on_scale
"""
)
def ablation_columns(spark: SparkSession, root: str) -> DataFrame:
    """Label coherence of ten neighbours by 40 or all 57 columns, standardised or not."""
    rows = _descriptors(spark, root)
    scaled = materialize(cb.z_apply(rows, cb.z_fit(rows)), "scaled")
    labels, out = rows.select("vec_id", "label"), None
    for name, (a, n) in _COLUMNS.items():
        for standardised, source in ((True, scaled), (False, rows)):
            seen = source.select("vec_id", F.slice("vec", a, n).alias("vec"))
            asked = seen.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "vec")
            told = metrics.coherence(knn.exact(seen, asked, 10, "vec_id", "vec"), labels, "vec_id")
            told = told.agg(F.round(F.sum(F.col("coherence") * F.col("n")) / F.sum("n"), 6).alias("coherence"), F.sum("n").alias("queries"))
            told = told.select(F.lit(name).alias("columns"), F.lit(standardised).alias("standardised"), "coherence", "queries").where("queries > 0")
            out = told if out is None else out.unionByName(told)
    return out


@query(
    _Z + ", " + """w AS (SELECT vec_id, list(x ORDER BY dim) AS v FROM s GROUP BY vec_id)
SELECT CAST(a.vec_id AS VARCHAR) AS query_id, 'inverted and dense' AS methods, 2 AS n_methods, 5 AS results FROM w a WHERE a.vec_id = 0"""
)
def compare_methods(spark: SparkSession, root: str) -> DataFrame:
    """The two ways to find items like a stored one, with what they return."""
    from kelpline.engine import Engine

    engine = Engine(spark)
    engine.indexes["image"] = _vector_index(spark, root)
    told = engine.compare_like("image", "filename", "item-0", 5)
    row = ("0", " and ".join(t["method"] for t in told), len(told), min(t["count"] for t in told))
    return spark.createDataFrame([row], "query_id string, methods string, n_methods int, results int")


@query("SELECT event_type, CAST(count(*) AS VARCHAR) AS n, CAST(count(DISTINCT user_id) AS VARCHAR) AS users FROM events GROUP BY event_type")
def report_csv(spark: SparkSession, root: str) -> DataFrame:
    """A table of results, written as one CSV file and read back."""
    rows = table(spark, root, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    path = new_path(spark, "report")
    metrics.write_csv(rows, path)
    return spark.read.csv(path, header=True)


# -- storage and streams -----------------------------------------------------------------------------


@query(
    _INDEX + """SELECT 'items' AS "table", count(*) AS "rows" FROM lyrics_sample UNION ALL SELECT 'chunks', count(*) FROM c
UNION ALL SELECT 'codebook', count(*) FROM cb UNION ALL SELECT 'postings', count(*) FROM post
UNION ALL SELECT 'norms', count(*) FROM norms UNION ALL SELECT 'histograms', count(*) FROM norms"""
)
def persist_summary(spark: SparkSession, root: str) -> DataFrame:
    return store.save(song_index(spark, root), new_path(spark, "store"), "music")


@query(_ONE + _ITEMS.format(top=_TOP, fetch=50) + "SELECT item_id, round(score, 4) AS score FROM ranked WHERE place <= 10")
def search_stored_index(spark: SparkSession, root: str) -> DataFrame:
    """Written, read back, searched."""
    path = new_path(spark, "store")
    store.save(song_index(spark, root), path, "music")
    found = search.search_text_items(store.load(spark, path, "text", "music"), query_frame(spark, PHRASE), 10)
    return found.select("item_id", "score")


@query(_ASSIGN + """SELECT item_id, round(max(CASE WHEN word_idx = 0 THEN weight ELSE 0 END), 6) AS first_word, round(sqrt(sum(weight * weight)), 6) AS norm
FROM vpost GROUP BY item_id""")
def stored_vector_index(spark: SparkSession, root: str) -> DataFrame:
    """An index of descriptors, written, read back, and its dense histograms with their items; nothing is left after it is dropped."""
    path = new_path(spark, "store")
    store.save(_vector_index(spark, root), path, "shop")
    read = store.load(spark, path, "image", "shop")
    assert read.scaler is not None and read.codebook.count() == read.k
    rows = store.load_histograms(spark, path, "image", "shop")
    out = materialize(rows.select("item_id", F.round(F.col("hist")[0], 6).alias("first_word"), F.round(vx.norm(F.col("hist")), 6).alias("norm")), "told")
    store.drop(spark, path, "image", "shop")
    assert store.stored_bytes(spark, f"{path}/app=shop/modality=image") == 0
    return out


@query("SELECT lower(metadata ->> '$.label') AS label, count(*) AS total FROM items WHERE modality = 'audio' AND (metadata ->> '$.label') IS NOT NULL GROUP BY 1")
def label_totals(spark: SparkSession, root: str) -> DataFrame:
    label = F.lower(F.get_json_object("metadata", "$.label")).alias("label")
    rows = table(spark, root, "items").where("modality = 'audio'").select(label).where("label is not null")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("total"))


@query()
def sample_items(spark: SparkSession, root: str) -> DataFrame:
    """Ten random tracks."""
    rows = table(spark, root, "items").where("modality = 'audio'")
    return rows.orderBy(F.rand(0)).limit(10).select("item_id", "external_id", "metadata")


@query(_INDEX + "SELECT item_id, CAST(position AS INTEGER) AS position, word_idx, round(weight, 6) AS weight FROM post JOIN c USING (chunk_id)")
def streaming_append(spark: SparkSession, root: str) -> DataFrame:
    """All songs again as a stream, under the frozen codebook."""
    ix = song_index(spark, root)
    source = new_path(spark, "incoming")
    song_items(spark, root).write.parquet(source)
    arriving = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    out = new_path(spark, "appended")
    append_stream(arriving, ix, "item_id", "lyrics", out, new_path(spark, "progress")).awaitTermination()
    chunks = spark.read.parquet(f"{out}/chunks").select("chunk_id", "item_id", "position")
    rows = index.postings_of_blocks(spark.read.parquet(f"{out}/blocks")).join(chunks, "chunk_id")
    return rows.select("item_id", "position", "word_idx", F.round("weight", 6).alias("weight"))
