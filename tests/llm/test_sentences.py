import pytest

from kelpline.llm import sentences as sn


@pytest.fixture(scope="module")
def splitter(spark, data):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return sn.Splitter(sn.learn_sentences(big, "text", "lang"))


def cut(splitter, text, lang):
    return [text[a:b] for a, b in splitter.spans(text, lang)]


@pytest.mark.parametrize(
    "lang, sentences",
    [
        ("en", ["Dr. Velto rated it at 9.5 points.", "The lantern burns slowly."]),
        ("en", ["The heel is 4.55 cm, i.e. 8 percent higher than the scarf.", "It waits."]),
        ("en", ['She said: "The tide never sleeps."', "The last tram waits for me."]),
        ("en", ["“Where is the lantern?” asked Tisdives.", "Really?!", "The moon waits."]),
        ("en", ["The rain falls over the fields...", "The red umbrella waits."]),
        ("en", ["Well... the lantern burns slowly.", "(It never sleeps.)", "So it goes."]),
        ("de", ["Das gilt z. B. über den Dächern, d. h. für Briditolen.", "Die Laterne wartet auf mich."]),
        ("de", ["Am 3. Mai spielt Velto unter der Brücke.", "Lomomar rief „Halt!“ und ging am Ende."]),
        ("es", ["Véase pág. 21 del vol. 1, p. ej. la linterna.", "¿Quién llama?", "¡El coro final canta!"]),
        ("fr", ["Velriko cria « Stop ! » et partit sous le pont.", "La pluie continue sans nous !"]),
        ("ru", ["См. стр. 5, рис. 7, т. е. больше.", "Старый фонарь ждёт меня."]),
    ],
)
def test_sentences_with_spaces(splitter, lang, sentences):
    assert cut(splitter, " ".join(sentences), lang) == sentences
    assert cut(splitter, "\n".join(sentences), lang) == sentences


@pytest.mark.parametrize(
    "lang, sentences",
    [
        ("zh", ["他说：“红雨伞学会了飞。”", "“小厨房在哪里？”她问。", "文件a_1.csv有12.42兆！", "旧灯笼没有声音……", "谁藏起红雨伞？"]),
        ("ja", ["彼は「赤い傘が眠らない。」と言った。", "「灯りはどこ？」と彼女が聞いた。", "紙の舟が眠らない！"]),
    ],
)
def test_scripts_without_spaces(splitter, lang, sentences):
    assert cut(splitter, "".join(sentences), lang) == sentences


def test_other_scripts(splitter):
    assert len(cut(splitter, "डॉ. Velto ने कहा कि लाल छाता कभी नहीं सोती। नीली नदी फिर लौट आती है!", "hi")) == 2
    assert len(cut(splitter, "أين قارب من ورق؟ الميناء الهادئ لا ينام أبدا. مطر الصباح يعود!", "ar")) == 3
    assert cut(splitter, "ร่มสีแดงราคา 53.3 บาทหัดบิน ครัวเล็กลืมครัวเล็ก", "th") == ["ร่มสีแดงราคา 53.3 บาทหัดบิน", "ครัวเล็กลืมครัวเล็ก"]


def test_blocks(splitter):
    text = "A heading 12\n\nThe lantern burns\nslowly. It waits\n- one item here\n- Another item.\n1. the last\n \n\tAn end without a mark"
    assert cut(splitter, text, "en") == [
        "A heading 12", "The lantern burns\nslowly.", "It waits", "- one item here", "- Another item.", "1. the last", "An end without a mark",
    ]


def test_small_letters_only(splitter):
    text = "the heel is 4 cm, i.e. 8 percent higher. after the dance the wall learns to fly. well... the lantern burns."
    assert len(cut(splitter, text, "en")) == 3


@pytest.mark.parametrize("text", [None, "", "  \n\t\n "])
def test_no_text(splitter, text):
    assert splitter.spans(text, "en") == []


@pytest.mark.parametrize("text", ["...", "?!", ". . .", "​", "a", "«", "1.", "- ", "“”", "end.\"", "x" * 50000, "a. " * 20000])
def test_odd_texts_cover_everything(splitter, text):
    spans = splitter.spans(text, None)
    held = "".join(text[a:b] for a, b in spans)
    assert held.replace(" ", "") == "".join(text.split())
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)


def test_operator(spark, data):
    rows = [(1, "One ends. Two ends.", "en"), (2, None, "en"), (3, " ", None), (1, "One ends. Two ends.", "en"), (None, "x", "en"), (4, "😀 uno. Dos", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "0 as start_pos", "'x' as sentence")
    out = sn.split_sentences(df, "doc_id", "text", "lang").orderBy("doc_id", "sentence_pos").collect()
    assert [(r["doc_id"], r["sentence"]) for r in out] == [(1, "One ends."), (1, "Two ends."), (4, "😀 uno."), (4, "Dos")]
    assert [(r["start_pos"], r["end_pos"]) for r in out] == [(0, 9), (10, 19), (0, 6), (7, 10)]
    assert sn.split_sentences(df.where("false"), "doc_id", "text").count() == 0


def test_spans_hold_all_but_white_space(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}
    found = sn.split_sentences(df, "doc_id", "text", "lang", unique_ids=True).toPandas().sort_values(["doc_id", "sentence_pos"])
    for doc, part in found.groupby("doc_id"):
        text, at = texts[doc], 0
        for r in part.itertuples():
            assert not text[at : r.start_pos].strip() and text[r.start_pos : r.end_pos] == r.sentence == r.sentence.strip()
            at = r.end_pos
        assert not text[at:].strip()
    assert set(found.doc_id) == {d for d, t in texts.items() if t.strip()}


def test_rare_followers_are_summed_before_the_cut(spark):
    """In a large language every follower of an abbreviation is rare, the abbreviation is not."""
    rows = [("en", "size", "", "", 10_000_000), ("en", "small", "the", "", 500_000), ("en", "bare", "the", "", 500_000)]
    rows += [("en", "period", "dr", f"Uname{i}", 1) for i in range(300)] + [("en", "period", "dr", "Uthe", 20)]
    rows += [("en", "period", "once", "lower", 1)]
    counted = spark.createDataFrame(rows, "lang string, kind string, key string, what string, n long")
    kept = {(r.key, r.what): r.n for r in sn.judged_counts(counted).where("kind = 'period'").collect()}
    assert kept == {("dr", "initial"): 300, ("dr", "end"): 20}
    seen = sn.learn([tuple(r) for r in sn.judged_counts(counted).collect()]).abbreviations["en"]["dr"]
    assert (seen.inner, seen.final) == (300, 20)
