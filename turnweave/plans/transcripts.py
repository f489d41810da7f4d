"""Queries of the core's training-data operator: speech periods and silences (p2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions.labels import usable
from turnweave.operators import intervals


def speech_states(spark: SparkSession, d: str) -> DataFrame:
    """Interval states of each dialogue and channel over the usable rows of word_transcripts."""
    words = spark.read.parquet(f"{d}/word_transcripts.parquet").select("dialogue_id", "speaker", "start", "end")
    rows = usable(words, spark.read.parquet(f"{d}/speaker_roles.parquet"))
    return intervals.interval_states(rows, *map(F.col, ("dialogue_id", "channel", "start_ms", "end_ms")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.gaps(speech_states(spark, d), 300, 60_000).select(
        F.col("entity").alias("dialogue_id"), F.col("part").alias("speaker"), F.col("gap_start").alias("gap_start_ms"), F.col("gap_end").alias("gap_end_ms")
    )


def p2_periods(spark: SparkSession, d: str) -> DataFrame:
    return intervals.periods(speech_states(spark, d)).select(
        F.col("entity").alias("dialogue_id"), F.col("part").alias("speaker"), F.col("period_start").alias("start_ms"), F.col("period_end").alias("end_ms")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p2_periods": p2_periods}


# Labels are reduced in SQL as in label_key: width, look-alikes, case, marks, a leading "speaker".
_USABLE = r"""
WITH squash AS (
  SELECT dialogue_id, CAST(round(start * 1000) AS BIGINT) AS s, CAST(round("end" * 1000) AS BIGINT) AS e,
    regexp_replace(regexp_replace(lower(translate(nfkc, 'АВЕЅІЈКМНОРСТУХаеорсухіјѕΑΒΕΖΗΙΚΜΝΟΡΤΥΧον', 'ABESIJKMHOPCTYXaeopcyxijsABEZHIKMNOPTYXov')), '[^\p{L}\p{N}]+', '', 'g'), '^(speaker|spk)', '') AS k
  FROM (SELECT *, translate(speaker, '{wide}', '{plain}') AS nfkc FROM word_transcripts) w
), roles AS (
  SELECT regexp_replace(lower(role), '[^\p{L}\p{N}]+', '', 'g') AS k, min(channel) AS channel
  FROM speaker_roles GROUP BY 1 HAVING min(channel) = max(channel)
), u AS (
  SELECT dialogue_id, channel, s, e FROM squash JOIN roles USING (k) WHERE s IS NOT NULL AND e > s
), reach AS (
  SELECT *, max(e) OVER (PARTITION BY dialogue_id, channel ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r,
    row_number() OVER (PARTITION BY dialogue_id, channel ORDER BY s, e) AS n FROM u
)
""".replace("{wide}", "".join(map(chr, range(0xFF01, 0xFF5F)))).replace("{plain}", "".join(map(chr, range(0x21, 0x7F))).replace("'", "''"))


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _USABLE
        + "SELECT dialogue_id, channel AS speaker, r AS gap_start_ms, s AS gap_end_ms FROM reach WHERE s - r BETWEEN 300 AND 60000",
        "p2_periods": _USABLE
        + """, island AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY dialogue_id, channel ORDER BY n) AS g FROM reach)
        SELECT dialogue_id, channel AS speaker, min(s) AS start_ms, max(e) AS end_ms FROM island GROUP BY dialogue_id, channel, g""",
    }
