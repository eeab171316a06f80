import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hemispark.llm import characters as ch

CASES = {
    "Мr Gеѕkаlmоllе": "Mr Geskalmolle", "Ｍａｄａｍ Ｓｐｅａｋｅｒ": "Madam Speaker", "Tｈe Chairperson": "The Chairperson", "𝐌𝐫 𝐀𝐦𝐚": "Mr Ama", "ﬁsh ﬂew": "fish flew", "été": "été", "Mr\xa0X Y　Z": "Mr X Y Z",
    "Ma​da­m": "Madam", "anti‑tetanus": "anti-tetanus", "Nɑrɑıⅼmɑc": "Narailmac", "аѕ it is": "as it is", "（１２）": "(12)", "е́tude": "étude",
}
KEPT = ["«правда»", "The letters Ω and β stand", "letter α here", "“q” – d’ — €5 £", "№ 5 ™", "a\nb\r\nc\td", "👩‍👧 ❤️", "Ελλάδα", "日本語", "", "plain"]


@pytest.mark.parametrize("raw,form", CASES.items())
def test_forms(raw, form):
    assert ch.normalize_text(raw) == form


@pytest.mark.parametrize("text", KEPT)
def test_kept(text):
    assert ch.normalize_text(text) == text


def test_null_and_long():
    assert ch.normalize_text(None) is None
    assert ch.normalize_text("ａ" * 200_000) == "a" * 200_000


def test_conflicts_are_refused():
    with pytest.raises(ValueError):
        ch.compile_mapping([("x", "a"), ("x", "b")])
    with pytest.raises(ValueError):
        ch.compile_mapping([("x", "y"), ("y", "z")])


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aZé ѕоОΑαβ́​­　\xa0ｆ𝐌ﬁ\n'-1"), st.characters())))
def test_second_pass_changes_nothing_and_ascii_stays(text):
    once = ch.normalize_text(text)
    assert ch.normalize_text(once) == once
    assert ch.normalize_text(text.encode("ascii", "ignore").decode()) == text.encode("ascii", "ignore").decode()


def test_untriggered_text_is_final(spark):
    from pyspark.sql import functions as F

    texts = [*CASES, *KEPT, "déjà vu", unicodedata.normalize("NFD", "déjà")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", F.col("t").rlike(ch.trigger()).alias("hit")).collect():
        assert r.hit or ch.normalize_text(r.t) == r.t


def test_operator(spark):
    rows = [("d", 0, "Ｍr X", "ok"), ("d", 0, "Ｍr X", "ok"), ("d", 1, None, "a​b"), ("d", 2, "x", None), ("d", 3, "", "")]
    df = spark.createDataFrame(rows, "debate_id string, seq_index int, speaker_raw string, text string").selectExpr("*", "'clash' AS field")
    got = {tuple(r) for r in ch.visually_identical(df, ["debate_id", "seq_index"], ["speaker_raw", "text"]).collect()}
    assert got == {("d", 0, "speaker_raw"), ("d", 1, "text")}
    assert ch.visually_identical(df.limit(0), ["debate_id", "seq_index"], ["text"]).count() == 0
    assert [r.text_norm for r in ch.normalize_columns(df, ["text"]).collect()] == ["ok", "ok", "ab", None, ""]
