"""Visually identical text with different characters: one consistent form (problem 5).

A text is composed, of ordinary width, free of invisible characters and of spaces other than the plain
one. Then the script sets of each token's letters are intersected. A token of one script that is not
the dialogue's own is a whole-script confusable if the public table of confusables spells each of its
letters in the own script, and takes that spelling; else it stays. A token whose sets have nothing in
common mixes scripts, and takes the spelling of the one script that can spell all of it, the own first.
"""

from __future__ import annotations

from collections.abc import Iterator

import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm.confusables import ALPHABETS, Spelling

# Own script of a language; languages not named here use Latin.
OWN_SCRIPT = {"ru": "Cyrillic", "ja": "Japanese"}
# Languages in which the dotless i is a letter of its own.
DOTLESS_I = ("tr", "az", "kk", "tt", "crh", "gag")

_INVISIBLE = regex.compile(r"[\p{Cf}\p{Default_Ignorable_Code_Point}]+")
_CONTROL = regex.compile(r"[\p{Cc}]+")
_SPACE = regex.compile(r"\s")
_CJK = r"\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Hangul}ー"
_TOKEN = regex.compile(rf"(?V1)[\p{{L}}--[{_CJK}]][[\p{{L}}\p{{M}}]--[{_CJK}]]*")
# Letters of phonetic notation, and the dotless i: look-alikes inside the Latin script.
_PHONETIC = regex.compile("[\u0131\u0250-\u02af\u1d00-\u1dbf]")
_PLAIN = {
    "Latin": regex.compile(r"(?V1)[[\P{L}A-Za-zÀ-ɏḀ-ỿ]--[\u0131\p{M}]]*"),
    "Cyrillic": regex.compile(r"(?V1)[[\P{L}\p{Script=Cyrillic}]--\p{M}]*"),
    "Japanese": regex.compile(rf"(?V1)[[\P{{L}}A-Za-z{_CJK}]--\p{{M}}]*"),
}
_KANA = regex.compile(r"[\p{Script=Katakana}ー]")
_ANY_KANA = regex.compile(r"[\p{Script=Katakana}\p{Script=Hiragana}ー]")
_HAN = regex.compile(r"\p{Script=Han}")


def _resolve(token: str, own: str, lang: str, spelling: Spelling) -> str:
    sets = [s for s in map(spelling.scripts, token) if s is not None]
    if not sets:  # letters newer than the tables at hand
        return token
    common = frozenset.intersection(*sets)
    if own == "Japanese":
        if common:
            return token
    elif own in common:
        return _plain_latin(token, lang, spelling) if own == "Latin" and _PHONETIC.search(token) else token
    else:
        spelled = spelling.spell(token, own)
        if spelled is not None:
            return spelled
        if common:
            return token
    present = frozenset.union(*sets)
    for script in ALPHABETS:
        if script in present and script != own:
            spelled = spelling.spell(token, script)
            if spelled is not None:
                return spelled
    if own not in ALPHABETS:
        return token
    spelled = spelling.spell(token, own, loose=True)
    if spelled is not None:
        return spelled
    twins = spelling.strict[own]
    return "".join(twins.get(ch, ch) for ch in token) if own in present else token


def _plain_latin(token: str, lang: str, spelling: Spelling) -> str:
    """A Latin token whose phonetic letters all look like basic ones, in basic letters; other tokens as they are."""
    if lang in DOTLESS_I:
        return token
    plain = "".join(spelling.strict["Latin"].get(ch, ch) if _PHONETIC.match(ch) else ch for ch in token)
    return token if _PHONETIC.search(plain) else plain


def _katakana(text: str, spelling: Spelling) -> str:
    """Kanji that stand for the katakana they look like.

    A run of katakana and such kanji is katakana if it holds any katakana. At the run's ends a kanji next
    to another kanji belongs to that one's word and stays. The length mark never begins a word: the
    stroke that looks like it is one only behind a kana, and at the front of a run only before another mark.
    """
    twins = spelling.katakana
    out, k, n = list(text), 0, len(text)
    while k < n:
        if not (text[k] in twins or _KANA.match(text[k])):
            k += 1
            continue
        a = k
        while k < n and (text[k] in twins or _KANA.match(text[k])):
            k += 1
        b = k
        if all(text[i] in twins for i in range(a, b)):
            continue
        lo, hi = a, b
        if a and _HAN.match(text[a - 1]):
            while text[lo] in twins:
                lo += 1
        if b < n and _HAN.match(text[b]):
            while text[hi - 1] in twins:
                hi -= 1
        for i in range(lo, hi):
            mark = twins.get(text[i])
            if mark is None:
                continue
            if mark == "ー" and i == lo:
                behind_kana = i > 0 and _ANY_KANA.match(text[i - 1])
                rest = i + 1
                while rest < hi and text[rest] in twins and twins[text[rest]] == "ー":
                    rest += 1
                if not (behind_kana and rest < hi and text[rest] == "ー"):
                    continue
            out[i] = mark
    return "".join(out)


def consistent_form(text: str | None, lang: str | None, spelling: Spelling) -> str | None:
    """The consistent form of a text in a dialogue of language ``lang``; null gives null.

    Case is kept; plain spaces at the ends are neither added nor removed. An unknown or missing
    language counts as one written in Latin letters.
    """
    if text is None:
        return None
    lang = (lang or "").lower()
    own = OWN_SCRIPT.get(lang, "Latin")
    if text.isascii() and text.isprintable():
        return text if own != "Cyrillic" else _TOKEN.sub(lambda m: _resolve(m[0], own, lang, spelling), text)
    text = _INVISIBLE.sub("", text)
    text = unicodedata.normalize("NFKC", text)
    text = _INVISIBLE.sub("", text)
    text = _CONTROL.sub("", _SPACE.sub(" ", text))
    if own == "Japanese" and any(ch in spelling.katakana for ch in text):
        text = _katakana(text, spelling)
    if _PLAIN[own].fullmatch(text):
        return text
    return _TOKEN.sub(lambda m: _resolve(m[0], own, lang, spelling), text)


class Forms:
    """Consistent forms with a bounded memory of the pairs seen last."""

    def __init__(self, spelling: Spelling, most: int = 200_000):
        self.spelling, self.most, self.seen = spelling, most, {}

    def __call__(self, text: str | None, lang: str | None) -> str | None:
        key = (text, lang)
        found = self.seen.get(key, self)
        if found is self:
            if len(self.seen) >= self.most:
                self.seen.clear()
            found = self.seen[key] = consistent_form(text, lang, self.spelling)
        return found


def form_column(text: Column, lang: Column, spelling: Spelling) -> Column:
    """``consistent_form`` as an Arrow-batched column expression."""

    @F.arrow_udf("string")
    def form(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        forms = Forms(spelling)
        for texts, langs in batches:
            yield pa.array(list(map(forms, texts.to_pylist(), langs.to_pylist())), type=pa.string())

    return form(text, lang)


def may_change(text: Column, spelling: Spelling) -> Column:
    """False for texts whose consistent form is the text in every language (built-in, never wrong that way).

    Those are printable ASCII texts without letters or with tokens that each hold a letter without a
    twin in the own script of another language. Everything else is left to the exact rule.
    """
    others = [s for s in set(OWN_SCRIPT.values()) if s in ALPHABETS and s != "Latin"]
    twins = "".join(sorted({ch for s in others for ch in spelling.loose[s] if ch.isascii()}))
    token_of_twins = rf"(^|[^A-Za-z])[{twins}]+([^A-Za-z]|$)"
    return ~(text.rlike(r"^[\x20-\x7E]*\z") & ~text.rlike(token_of_twins))


def languages(dialogues: DataFrame) -> DataFrame:
    """One language per dialogue; dialogues delivered twice agree in it, else the smaller counts."""
    return dialogues.groupBy("dialogue_id").agg(F.min("lang").alias("_lang"))


def with_form(rows: DataFrame, dialogues: DataFrame, text: str = "word", out: str = "form", spelling: Spelling | None = None) -> DataFrame:
    """Add the consistent form of ``text``. Null texts give null; unknown dialogues count as Latin.

    ``spelling`` holds the table of confusables; by default it is read from the running Spark's library.
    """
    joined = rows.drop(out, "_lang").join(languages(dialogues), "dialogue_id", "left")
    return joined.withColumn(out, form_column(F.col(text), F.col("_lang"), spelling or Spelling())).drop("_lang")


def changed_rows(rows: DataFrame, dialogues: DataFrame, text: str = "word", spelling: Spelling | None = None) -> DataFrame:
    """Rows whose text is not null and differs from its consistent form, with that form.

    Rows that cannot change in any language are dropped before the join and the Python stage.
    """
    spelling = spelling or Spelling()
    suspects = rows.where(F.col(text).isNotNull() & may_change(F.col(text), spelling))
    return with_form(suspects, dialogues, text, spelling=spelling).where(~F.col(text).eqNullSafe(F.col("form")))
