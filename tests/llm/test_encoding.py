import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from kelpline.llm import encoding as en  # noqa: E402

TEXTS = [
    (1, "Hello world, it's 2024!  Two  spaces\n\n\tand tabs "), (2, None), (3, ""), (4, "   "), (5, "<|endoftext|> is text"),
    (6, "中文句子。日本語のテキスト　全角"), (7, "é̂ 👩‍🎤  \x85 x\x1c y"), (8, "ab" * 60000), (9, "the " * 30000), (None, "gone"),
    (1, "Hello world, it's 2024!  Two  spaces\n\n\tand tabs "),
]


@pytest.fixture(scope="module")
def direct():
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("block", [50, 1_000_000])
def test_ids_equal_the_tokenizers(spark, direct, block):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("doc_id", "text", "'clash' as words", "1 as ids")
    out = {r["doc_id"]: r["ids"] for r in en.encode_corpus(df, "doc_id", "text", block_chars=block).collect()}
    assert out == {i: direct(t) for i, t in TEXTS if i is not None}


def test_round_trip(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    back = {r["doc_id"]: r["text"] for r in en.decode_corpus(en.encode_corpus(df, "doc_id", "text"), "doc_id").collect()}
    assert back == {i: t or "" for i, t in TEXTS if i is not None}


def test_words_join_to_the_text():
    for _, text in TEXTS:
        assert "".join(en.split_words(text or "")) == (text or "")


def test_whole_table(spark, data, direct):
    df = spark.read.parquet(f"{data}/documents.parquet")
    want = {r["doc_id"]: direct(r["text"]) for r in df.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["ids"] for r in en.encode_corpus(df, "doc_id", "text", unique_ids=True).collect()}
    assert got == want


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert en.encode_corpus(empty, "doc_id", "text").count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in en.decode_corpus(nulls, "doc_id").collect()} == {1: None, 2: ""}
    with pytest.raises(ValueError):
        en.encode_corpus(empty, "doc_id", "body")
