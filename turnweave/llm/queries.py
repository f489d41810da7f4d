"""The training-data queries p1, p3..p9 over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm import bpe, cutoff, forms, leaks, packing, pieces, spans, turns
from turnweave.operators import intervals


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "word_transcripts"), table(spark, d, "speaker_roles"), table(spark, d, "dialogues")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every transcript in ordered pieces of at most 50 s and 600 characters, with their text."""
    return pieces.split_transcripts(*_words(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.oversized(pieces.split_transcripts(*_words(spark, d), with_text=False))


def p3_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every dialogue, or part of one longer than 1,024 frames, with its container."""
    return packing.pack_dialogues(table(spark, d, "dialogue_tokens"))


def p3_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers of the whole table are filled: at most 1 % over the fewest that could hold its frames."""
    out = packing.fill(packing.pack_dialogues(table(spark, d, "dialogue_tokens")))
    return out.select("n_items", "frames", "fewest", (F.col("n_containers") <= 1.01 * F.col("fewest") + 1).alias("tight"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.split_dialogues(packing.pack_dialogues(table(spark, d, "dialogue_tokens")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    fillers = turns.filler_forms(table(spark, d, "fillers"))
    out = turns.speaker_turns(*_words(spark, d), fillers, with_text=False)
    return out.select("dialogue_id", F.col("channel").alias("speaker"), "first_row_id", "last_row_id")


def p4_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns with their text, rolled-on captions cut back (within 10 s) and split at pauses too: the longest 2 % of a language's silences, in whole 100 ms."""
    fillers = turns.filler_forms(table(spark, d, "fillers"))
    words, roles, dialogues = _words(spark, d)
    # One number per language; languages are a closed vocabulary.
    found = {r.lang: round(r.pause_ms, -2) for r in turns.calibrated_pauses(words, roles, dialogues, 0.98).collect()}
    return turns.speaker_turns(words, roles, dialogues, fillers, pauses={None: 2_000} | found, rolling_ms=10_000)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return forms.changed_rows(table(spark, d, "word_transcripts"), table(spark, d, "dialogues")).select("row_id")


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every row of word_transcripts with its word in consistent form."""
    return forms.with_form(table(spark, d, "word_transcripts"), table(spark, d, "dialogues")).select("row_id", "word", "form")


def p6_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """Per source: the cutoff that keeps 80 %, records counted and records kept."""
    return cutoff.cutoffs(cutoff.counted(table(spark, d, "cer_all")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    records = cutoff.counted(table(spark, d, "cer_all"))
    return cutoff.kept(records, cutoff.cutoffs(records)).select("stem")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"))


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(_passages(spark, d))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Each leaked item with the number of documents that hold a passage of it."""
    return leaks.leaked_items(_passages(spark, d)).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def p8_proximity(spark: SparkSession, d: str) -> DataFrame:
    """Documents in which three or more tokens of an item stand within 400 reduced characters, in any order."""
    return leaks.proximity(leaks.build_index(table(spark, d, "documents")), table(spark, d, "benchmark"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_pairs(table(spark, d, "documents"))


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """Each document's spans that stand verbatim in another one; ``span`` is the same wherever the text is the same."""
    return spans.shared_spans(table(spark, d, "documents"))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document is shared: stretches of characters that lie in shared spans, their number, length and share."""
    documents = table(spark, d, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.length("text").alias("n_chars"))
    states = intervals.interval_states(spans.shared_spans(table(spark, d, "documents")), F.col("doc_id"), F.lit(""), F.col("start"), F.col("end"))
    merged = intervals.periods(states).select(F.col("entity").cast("bigint").alias("doc_id"), F.col("period_start").alias("s"), F.col("period_end").alias("e"))
    totals = merged.groupBy("doc_id").agg(F.count("*").alias("n_stretches"), F.sum(F.col("e") - F.col("s")).cast("bigint").alias("shared_chars"), F.max(F.col("e") - F.col("s")).cast("bigint").alias("longest_stretch"))
    return totals.join(documents, "doc_id").withColumn("share", F.round(F.col("shared_chars") / F.col("n_chars"), 9))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p3_found, p3_containers, p3_fill, p4_found, p4_turns, p5_found, p5_forms, p6_found, p6_cutoffs, p7_ids, p8_found, p8_items, p8_proximity, p9_found, p9_spans, p9_shared)}


_LENGTHS = """WITH l AS (
  SELECT dialogue_id, arg_max(greatest(coalesce(list_max(list_transform("A", lambda x: coalesce(len(x), 0))), 0), coalesce(list_max(list_transform("B", lambda x: coalesce(len(x), 0))), 0)),
    {'t': exported_at, 'r': row_id}) AS frames FROM dialogue_tokens GROUP BY dialogue_id)
"""
_COUNTED = r"""WITH named AS (
  SELECT lower(regexp_replace(regexp_extract(trim(stem), '([^/\\]*)$', 1), '\.[A-Za-z][A-Za-z0-9]{0,5}$', '')) AS stem, cer, scored_at, rec_id FROM cer_all WHERE stem IS NOT NULL
), latest AS (
  SELECT stem, cer FROM named QUALIFY row_number() OVER (PARTITION BY stem ORDER BY scored_at DESC NULLS LAST, rec_id DESC) = 1
), counted AS (
  SELECT stem, cer, array_to_string(string_split(stem, '_')[1:2], '_') AS source FROM latest WHERE cer IS NOT NULL AND NOT isnan(cer) AND NOT isinf(cer) AND cer >= 0
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY source) AS n, count(*) OVER (PARTITION BY source ORDER BY cer RANGE UNBOUNDED PRECEDING) AS rank FROM counted
), cut AS (SELECT source, min(cer) AS cutoff, any_value(n) AS n_records, min(rank) AS n_kept FROM ranked WHERE rank * 100 >= n * 80 GROUP BY source)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _LENGTHS + "SELECT dialogue_id FROM l WHERE frames > 1024",
        "p3_fill": _LENGTHS + "SELECT coalesce(sum(ceil(frames / 1024.0)), 0)::BIGINT AS n_items, coalesce(sum(frames), 0)::BIGINT AS frames, ceil(coalesce(sum(frames), 0) / 1024.0)::BIGINT AS fewest, true AS tight FROM l WHERE frames > 0",
        "p6_found": _COUNTED + "SELECT stem FROM counted JOIN cut USING (source) WHERE cer <= cutoff",
        "p9_found": """WITH g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(length(text) - 119), lambda i: text[i + 1:i + 120])) AS s FROM documents WHERE length(text) >= 120)
            SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM g a JOIN g b USING (s) WHERE a.doc_id < b.doc_id""",
        "p9_shared": """WITH g AS (SELECT doc_id, i, text[i + 1:i + 120] AS s FROM (SELECT doc_id, text, unnest(range(length(text) - 119)) AS i FROM documents WHERE length(text) >= 120)),
            hit AS (SELECT doc_id, i FROM g SEMI JOIN (SELECT s FROM g GROUP BY s HAVING count(DISTINCT doc_id) > 1) USING (s)),
            run AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM
              (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 120 THEN 0 ELSE 1 END AS fresh FROM hit)),
            part AS (SELECT doc_id, r, max(i) + 120 - min(i) AS n FROM run GROUP BY ALL)
            SELECT doc_id, count(*) AS n_stretches, sum(n)::BIGINT AS shared_chars, max(n) AS longest_stretch, any_value(length(text))::INT AS n_chars, round(sum(n) / any_value(length(text)), 9) AS share
            FROM part JOIN documents USING (doc_id) GROUP BY doc_id""",
        "p6_cutoffs": _COUNTED + "SELECT source, cutoff, n_records, n_kept FROM cut",
    }
