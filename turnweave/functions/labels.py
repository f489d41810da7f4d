"""Speaker labels to channels, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like a Latin letter.
CYRILLIC_AS_LATIN = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
}
GREEK_AS_LATIN = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v",
}

# Words that may stand before the role in a label.
LABEL_PREFIX = "^(speaker|spk)"


def fold_fullwidth(text: Column) -> Column:
    """Full-width ASCII (U+FF01..U+FF5E) to ASCII; other characters stay. Null stays null."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    plain = "".join(map(chr, range(0x21, 0x7F)))
    return F.translate(text, wide, plain)


def label_key(label: Column) -> Column:
    """A label reduced to the letters and digits of the role it names.

    Width, look-alike letters, case, invisible characters, marks and a leading "speaker" go away.
    A label of two roles ("A/B") gives a key that is no role's. Null gives null.
    """
    latin = CYRILLIC_AS_LATIN | GREEK_AS_LATIN
    folded = F.translate(fold_fullwidth(label), "".join(latin), "".join(latin.values()))
    squashed = F.regexp_replace(F.lower(folded), r"[^\p{L}\p{N}]+", "")
    return F.regexp_replace(squashed, LABEL_PREFIX, "")


def with_channel(rows: DataFrame, roles: DataFrame, label: str = "speaker", out: str = "channel") -> DataFrame:
    """Add the channel of the one role that ``label`` names; null where it names none or several.

    ``roles`` is the fixed role vocabulary (``role``, ``channel``). Two roles that reduce to one key
    but sit in different channels name no channel. No hint is given: the optimizer broadcasts the
    vocabulary by its size and would shuffle it, were it large.
    """
    keyed = (
        roles.select(label_key(F.col("role")).alias("_role_key"), F.col("channel").alias("_channel"))
        .where("_role_key IS NOT NULL AND _role_key <> ''")
        .groupBy("_role_key")
        .agg(F.min("_channel").alias("_low"), F.max("_channel").alias("_high"))
        .where("_low = _high")
        .select("_role_key", F.col("_low").alias(out))
    )
    return (
        rows.drop(out).withColumn("_role_key", label_key(F.col(label))).join(keyed, "_role_key", "left").drop("_role_key")
    )


def to_ms(seconds: Column) -> Column:
    """Seconds to whole milliseconds; NaN and values beyond ±1e12 s count as missing."""
    ms = F.round(seconds * 1000.0)
    return F.when(F.isnan(seconds) | (F.abs(seconds) > 1e12), F.lit(None)).otherwise(ms).cast("bigint")


def usable(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """Rows that have a channel, both times, and ``end`` after ``start`` (compared in milliseconds).

    Adds ``channel``, ``start_ms`` and ``end_ms``. Rows delivered twice are not merged here.
    """
    timed = rows.withColumns({"start_ms": to_ms(F.col("start")), "end_ms": to_ms(F.col("end"))})
    timed = timed.where("start_ms IS NOT NULL AND end_ms IS NOT NULL AND end_ms > start_ms")
    return with_channel(timed, roles).where("channel IS NOT NULL")
