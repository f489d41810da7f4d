import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnweave.llm.confusables import Spelling, default_path, prototypes
from turnweave.llm.forms import changed_rows, consistent_form, may_change, with_form

SPELLING = Spelling()

CASES = [
    ("harbou­r", "en", "harbour"), ("ｅｌ", "es", "el"), ("wі​th", "en", "with"), ("naïνe", "en", "naïve"), ("café", "en", "café"),
    ("асе", "en", "ace"), ("Москва", "en", "Москва"), ("пoэтому", "ru", "поэтому"), ("email", "ru", "email"), ("wiﬁ", "ru", "wifi"), ("cop", "ru", "сор"),
    ("через email", "ru", "через email"), ("[2.9s]", "ru", "[2.9s]"), ("8.8ѕ", "en", "8.8s"), ("力メラ", "ja", "カメラ"), ("ロ一プ", "ja", "ロープ"), ("八ンマー", "ja", "ハンマー"),
    ("二人", "ja", "二人"), ("力", "ja", "力"), ("ﾊﾝﾏｰ", "ja", "ハンマー"), ("ダ゙", "ja", unicodedata.normalize("NFKC", "ダ゙")), ("ガ", "ja", "ガ"), (" a　", "en", " a "), (" a ", "en", " a "),
    ("", "en", ""), (None, "en", None), ("саn't", None, "can't"), ("А" * 5000, "de", "A" * 5000),
    ("һello", "en", "hello"), ("ԁog", "en", "dog"), ("ԛueen", "en", "queen"), ("ɡo", "en", "go"), ("ոot", "en", "not"), ("αlpha", "en", "alpha"), ("γes", "en", "yes"), ("qυeen", "en", "queen"),
    ("кiss", "en", "kiss"), ("вhy", "en", "bhy"), ("Ꭺpple", "en", "Apple"), ("nᴏt", "en", "not"), ("ıt", "en", "it"), ("ısı", "tr", "ısı"), ("ɡəʊ", "en", "ɡəʊ"), ("ёlf", "de", "ëlf"),
    ("入力カード", "ja", "入力カード"), ("ビル一階", "ja", "ビル一階"), ("一ドル", "ja", "一ドル"), ("う一ーん", "ja", "うーーん"), ("夕クシ一", "ja", "タクシー"), ("口一ド", "ja", "ロード"),
    ("кнопka", "ru", "кнопка"), ("еmail", "ru", "email"), ("eщë", "ru", "ещё"), ("wifi[шум]", "ru", "wifi[шум]"),
]


@pytest.mark.parametrize("text,lang,expected", CASES)
def test_cases(text, lang, expected):
    assert consistent_form(text, lang, SPELLING) == expected


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=12), st.sampled_from(["en", "ru", "ja", None]))
def test_a_consistent_form_is_its_own(text, lang):
    form = consistent_form(text, lang, SPELLING)
    assert consistent_form(form, lang, SPELLING) == form


def test_prefilter_never_drops_a_change(spark):
    texts = sorted({t for t, _, _ in CASES if t is not None} | {"a", "y", "ok", "can't", "A-b", "cop x", "hello", "12", "pace?"})
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", may_change(F.col("t"), SPELLING).alias("may")).collect()
    for r in rows:
        if not r.may:
            assert all(consistent_form(r.t, lang, SPELLING) == r.t for lang in ("en", "ru", "ja", "de"))


@pytest.mark.parametrize("end", ["\n", "\r", "\r\n", "\x85", "\u2028", "\u2029"])
def test_a_line_terminator_at_the_end_is_a_change(spark, transcripts, end):
    words, _, dialogues = transcripts([(1, "d", "A", f"hello{end}", 0.0, 1.0), (2, "d", "A", "hello", 1.0, 2.0)])
    assert consistent_form(f"hello{end}", "en", SPELLING) != f"hello{end}"
    assert [r.row_id for r in changed_rows(words, dialogues).collect()] == [1]


def test_rows(spark, transcripts):
    words, _, dialogues = transcripts([(1, "d", "A", "wіth", 0.0, 1.0), (2, "d", None, "with", None, None), (3, "d", "A", None, 0.0, 1.0), (4, "r", "?", "cop", 1.0, 0.0), (5, None, "A", "ｘ", 0.0, 1.0)], {"r": "ru"})
    assert {r.row_id for r in changed_rows(words, dialogues).collect()} == {1, 4, 5}
    assert {(r.row_id, r.form) for r in with_form(words, dialogues).collect()} == {(1, "with"), (2, "with"), (3, None), (4, "сор"), (5, "x")}
    assert changed_rows(words.limit(0), dialogues).count() == 0


def test_the_table_of_confusables(tmp_path):
    import zipfile

    table = prototypes()
    assert table["а"] == "a" and table["І"] == "l" and table["m"] == "rn" and len(table) > 6_000
    with zipfile.ZipFile(default_path()) as jar:
        raw = jar.read(next(n for n in jar.namelist() if n.endswith("confusables.cfu")))
    (tmp_path / "confusables.cfu").write_bytes(raw)
    assert prototypes(str(tmp_path / "confusables.cfu")) == table
    (tmp_path / "no.cfu").write_bytes(raw[:144] + b"0" * 64)
    with pytest.raises(ValueError):
        prototypes(str(tmp_path / "no.cfu"))
