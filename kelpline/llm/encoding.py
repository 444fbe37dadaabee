"""Token ids of a corpus by a byte-level BPE, with every distinct word encoded once.

1. Texts are split into words by the tokenizer's own pattern and grouped into blocks of bounded size.
   A block holds its distinct words once and every text as a list of positions in that list.
2. The distinct words of all blocks form one table; each of its words is encoded once.
3. The ids are joined back to the blocks by word, and each text is put together by position.

So a word that stands in every text crosses the network once per block, not once per occurrence.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm.common import check_columns, latest_per_id
from kelpline.runtime import materialize, release

#: Fixed value: the pattern by which this tokenizer splits a text before its merges.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: white space by the Unicode property, spelled out for the two shorthands of the pattern.
WHITE_SPACE = r"\t\n\x0b\f\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=1)
def _splitter():
    import regex

    pattern = SPLIT_PATTERN.replace(r"[^\s\p{L}", rf"[^{WHITE_SPACE}\p{{L}}")
    pattern = pattern.replace(r"\s+(?!\S)", rf"[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])").replace(r"|\s+", rf"|[{WHITE_SPACE}]+")
    return regex.compile(pattern)


def split_words(text: str) -> list[str]:
    """The words of a text; joined they give the text again."""
    return _splitter().findall(text)


@lru_cache(maxsize=4)
def load_encoder(ranks_path: str):
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_ranks_path() -> str:
    """The installed vocabulary file of the byte-level BPE with 50,256 ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _blocks(id_col: str, id_type: pa.DataType, block_chars: int):
    schema = pa.schema(
        [
            ("block", pa.string()),
            ("words", pa.list_(pa.string())),
            ("keys", pa.list_(id_type)),
            ("lengths", pa.list_(pa.int32())),
            ("codes", pa.list_(pa.int32())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        words: dict[str, int] = {}
        keys: list = []
        lengths: list[int] = []
        codes: list[int] = []
        chars = 0

        def flush() -> pa.RecordBatch:
            nonlocal words, keys, lengths, codes, chars, made
            columns = [[f"{part}-{made}"], [list(words)], [keys], [lengths], [np.asarray(codes, dtype=np.int32)]]
            made += 1
            words, keys, lengths, codes, chars = {}, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                found = split_words(text)
                keys.append(key)
                lengths.append(len(found))
                codes += [words.setdefault(w, len(words)) for w in found]
                chars += len(text) + 1
                if chars >= block_chars:
                    yield flush()
        if keys:
            yield flush()

    return run


def _encode_words(ranks_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(ranks_path)
        for batch in batches:
            words = batch.column(0)
            ids = [encoder.encode_ordinary(w) for w in words.to_pylist()]
            yield pa.RecordBatch.from_arrays([words, pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def _assemble(id_type: pa.DataType):
    schema = pa.schema([("key", id_type), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name).slice(i, 1) for name in ("keys", "lengths", "codes", "at", "word_ids")}
                codes = row["codes"].values.to_numpy()[_span(row["codes"])]
                lengths = row["lengths"].values.to_numpy()[_span(row["lengths"])]
                keys = row["keys"].flatten()
                at = row["at"].flatten().to_numpy()
                nested = row["word_ids"].flatten()
                values = nested.flatten().to_numpy(zero_copy_only=False)
                size = nested.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                begin = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else np.zeros(0, np.int64)
                n = int(at.max()) + 1 if len(at) else 0
                first, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
                first[at], count[at] = begin, size
                per_word = count[codes]
                total = int(per_word.sum())
                shift = np.cumsum(per_word) - per_word
                take = np.repeat(first[codes] - shift, per_word) + np.arange(total)
                ends = np.concatenate([[0], np.cumsum(per_word)])[np.concatenate([[0], np.cumsum(lengths)])]
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[take], pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.cast(id_type), ids], schema=schema)

    return run


def _span(column: pa.ListArray) -> slice:
    return slice(column.offsets[0].as_py(), column.offsets[-1].as_py())


def encode_corpus(
    df: DataFrame,
    id_col: str,
    text_col: str,
    ranks_path: str | None = None,
    block_chars: int = 1_000_000,
    order: list[str] | None = None,
    unique_ids: bool = False,
) -> DataFrame:
    """(``id_col``, ids) of every record; null and empty texts give an empty list.

    No special token is ever produced; their strings in a text are ordinary text.  Repeated ids count
    once (the greatest by ``order``, then text) unless ``unique_ids`` states that there are none, which
    saves a shuffle of the texts; null ids are left out.  Other columns are ignored.  A text longer
    than ``block_chars`` has a block of its own.  ``ranks_path`` must exist on every executor.
    """
    check_columns(df, id_col, text_col)
    ranks_path = ranks_path or default_ranks_path()
    rows = df.select(id_col, text_col, *[c for c in order or [] if c not in (id_col, text_col)])
    if unique_ids:
        rows = rows.where(F.col(id_col).isNotNull())
    else:
        rows = latest_per_id(rows, id_col, [text_col], order)
    rows = rows.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    key_type = rows.schema["key"].dataType.simpleString()
    arrow = pa.int32() if key_type == "int" else pa.int64() if key_type == "bigint" else pa.string()
    if arrow == pa.string():
        rows, key_type = rows.withColumn("key", F.col("key").cast("string")), "string"
    schema = f"block string, words array<string>, keys array<{key_type}>, lengths array<int>, codes array<int>"
    blocks = materialize(rows.mapInArrow(_blocks(id_col, arrow, block_chars), schema), "word-blocks")
    uses = blocks.select("block", F.posexplode("words").alias("at", "word"))
    encoded = uses.select("word").distinct().mapInArrow(_encode_words(ranks_path), "word string, ids array<int>")
    back = (
        uses.join(encoded, "word")
        .groupBy("block")
        .agg(F.collect_list(F.struct("at", "ids")).alias("found"))
        .select("block", F.col("found.at").alias("at"), F.col("found.ids").alias("word_ids"))
    )
    empty = F.array()
    joined = blocks.drop("words").join(back, "block", "left")
    joined = joined.withColumn("at", F.coalesce("at", empty.cast("array<int>")))
    joined = joined.withColumn("word_ids", F.coalesce("word_ids", empty.cast("array<array<int>>")))
    return joined.select("keys", "lengths", "codes", "at", "word_ids").mapInArrow(
        _assemble(arrow), f"`{id_col}` {key_type}, ids array<int>".replace(f"`{id_col}`", "key")
    ).withColumnRenamed("key", id_col)


def pieces(spark: SparkSession, ranks_path: str | None = None) -> DataFrame:
    """(id, piece): the bytes of every id; as many rows as the vocabulary has."""
    with open(ranks_path or default_ranks_path(), "rb") as lines:
        rows = [(int(rank), bytearray(base64.b64decode(piece))) for piece, rank in map(bytes.split, lines)]
    return spark.createDataFrame(rows, "id int, piece binary")


def decode_corpus(encoded: DataFrame, id_col: str, ids_col: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """(``id_col``, text): the way back, by a join of ids with the vocabulary's pieces.

    The vocabulary (a fixed 50 k rows) is broadcast.  Empty lists give an empty text, null lists null;
    unknown ids raise no error and add nothing; broken UTF-8 is replaced.
    """
    table = F.broadcast(pieces(encoded.sparkSession, ranks_path))
    given = F.col(ids_col).isNotNull().alias("_given")
    rows = encoded.select(id_col, given, F.posexplode_outer(ids_col).alias("_pos", "_id"))
    joined = rows.join(table, F.col("_id") == F.col("id"), "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.hex("piece").alias("h")))), lambda x: x["h"]), "")
    grouped = joined.groupBy(id_col).agg(text.alias("_hex"), F.max("_given").alias("_given"))
    return grouped.select(id_col, F.when(F.col("_given"), F.expr("decode(unhex(_hex), 'UTF-8')")).alias("text"))


__all__ = ["decode_corpus", "encode_corpus", "load_encoder", "pieces", "release", "split_words"]
