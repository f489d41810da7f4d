"""Queries of the operators that SQL cannot express: folds, tokenizers, edit distance. Tests hold them to brute force."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions import arrays as X
from turnweave.functions import text as T
from turnweave.functions.labels import usable
from turnweave.operators import align
from turnweave.plans.corpus import docs, read, turns
from turnweave.plans.token_streams import LEAST, MOST, matrix_rows, sides
from turnweave.streaming.live import jitter


def _words(spark, d):
    rows = usable(read(spark, d, "word_transcripts"), read(spark, d, "speaker_roles"))
    return rows.select("dialogue_id", "channel", "word", "start", "end", "row_id")


def tok01_frame_align(spark, d):
    """Frame ids of each dialogue and channel; an empty word makes a stream an error, which stands in its row."""
    return align.frame_align(_words(spark, d)).select("dialogue_id", "channel", F.size("ids").alias("n"), X.digest(F.col("ids")).alias("digest"), "dropped", "error")


def tok02_frame_align_lenient(spark, d):
    return align.frame_align(_words(spark, d), lenient=True).select("dialogue_id", "channel", F.size("ids").alias("n"), X.digest(F.col("ids")).alias("digest"), "dropped", "error")


def tok14_merge_speakers(spark, d):
    return matrix_rows(align.merged_streams(sides(spark, d)), ["row_id"], "streams")


def tok15_preprocess_tts(spark, d):
    return matrix_rows(align.preprocess_tts(sides(spark, d), MOST, LEAST), ["row_id", "part"], "labels")


def str02_normalize_ja(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.normalize_ja(F.col("text"))).alias("digest"))


def str10_error_rate(spark, d):
    """Character error rate between neighbouring turns of a text."""
    t = turns(spark, d)
    other = t.select("doc_id", (F.col("pos") - 1).alias("pos"), F.col("text").alias("hyp"))
    return t.join(other, ["doc_id", "pos"]).select("doc_id", "pos", F.round(T.error_rate(F.col("text"), F.col("hyp")), 9).alias("cer"))


def stm06_jitter(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", (F.col("value") % 40).alias("arrive_ms"), F.lit(20.0).alias("play_ms"))
    return jitter(e, every=10)


def stm09_text_cursor(spark, d):
    """The text row of a run in which A's text row is what the model emits and B's text is what it has to say."""
    from turnweave.streaming.live import text_cursor

    @F.arrow_udf("array<int>")
    def placed(emissions: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([text_cursor(e, t) for e, t in zip(emissions.to_pylist(), texts.to_pylist())], type=pa.list_(pa.int32()))

    rows = sides(spark, d).withColumn("texts", F.filter(F.get("B", F.lit(0)), lambda x: ~x.isin(0, 3)))
    out = rows.select("row_id", placed(F.get("A", F.lit(0)), F.col("texts")).alias("ids"))
    return out.select("row_id", F.size("ids").alias("n"), X.digest(F.col("ids")).alias("digest"))


def stm09_held_audio(spark, d):
    """A's audio rows as a run gives them: the initial id stands until a row's delay, less one frame of prompt, has passed."""
    from turnweave.streaming.live import held_audio

    held = held_audio(F.slice("A", 2, 8), [0, 1, 2, 3, 1, 1, 1, 4], 1, 2_048)
    return matrix_rows(sides(spark, d).withColumn("streams", held), ["row_id"], "streams")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if re.match(r"[a-z]{3}\d\d_", k)}


def oracle_sql() -> dict[str, str]:
    from turnweave.plans import corpus as P
    from turnweave.plans import sql as Q

    digest = lambda a: f"md5(array_to_string(list_transform({a}, lambda q: CAST(q AS VARCHAR)), ','))"
    one_byte = lambda t: f"array_to_string(list_transform(string_split({t}, ''), lambda q: chr(coalesce(nullif(list_position(cs, q), 0), 127)::INTEGER)), '')"
    # Cells with who speaks (1 main, 2 other), runs of a speaker, and what becomes of each run: a marker's cell, a cell given up, or nothing.
    merged = f"""WITH {Q.V1}, c AS (SELECT row_id, unnest(range(t)) AS k, unnest(a[1]) AS x, unnest(b[1]) AS y FROM v1),
        w AS (SELECT *, CASE WHEN x NOT IN (0, 3) THEN 1 WHEN y NOT IN (0, 3) THEN 2 ELSE 0 END AS who FROM c),
        f AS (SELECT *, CASE WHEN who = lag(who) OVER (PARTITION BY row_id ORDER BY k) THEN 0 ELSE 1 END AS fresh FROM w WHERE who > 0),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY row_id ORDER BY k) AS run FROM f),
        r AS (SELECT row_id, run, any_value(who) AS who, count(*) AS n, min(k) AS first, max(k) AS last, min(k) FILTER (nth = 2) AS second FROM (SELECT *, row_number() OVER (PARTITION BY row_id, run ORDER BY k) AS nth FROM g) GROUP BY 1, 2),
        q AS (SELECT *, lag(last) OVER u AS prev_last, lag(n) OVER u AS prev_n, lag(first) OVER u AS prev_first, lag(last, 2) OVER u AS last2, lag(n, 2) OVER u AS n2, lag(first, 2) OVER u AS first2 FROM r WINDOW u AS (PARTITION BY row_id ORDER BY run)),
        h AS (SELECT *, first = 0 OR (who = 2 AND prev_last IS NOT NULL AND prev_last = first - 1) AS tight, prev_last IS NOT NULL AND who = 1 AND prev_n = 1 AND (prev_first = 0 OR (last2 IS NOT NULL AND last2 = prev_first - 1)) AS after_gone FROM q),
        v AS (SELECT *, CASE WHEN who = 1 AND after_gone AND n2 IS NOT NULL AND NOT (first2 = 0 AND n2 = 1) THEN NULL WHEN tight AND n = 1 THEN NULL WHEN tight THEN second - 1 ELSE first - 1 END AS mark FROM h),
        lost AS (SELECT row_id, first AS k FROM v WHERE tight AND who = 2), marks AS (SELECT row_id, mark AS k, who FROM v WHERE mark IS NOT NULL),
        o AS (SELECT w.row_id, w.k, CASE WHEN lost.k IS NOT NULL THEN x WHEN w.who = 1 THEN x WHEN w.who = 2 THEN y WHEN x = 0 OR y = 0 THEN 0 ELSE 3 END AS z, marks.who AS marker FROM w LEFT JOIN lost ON lost.row_id = w.row_id AND lost.k = w.k LEFT JOIN marks ON marks.row_id = w.row_id AND marks.k = w.k),
        e AS (SELECT *, lead(z) OVER l AS next_z, lead(marker) OVER l AS next_marker FROM o WINDOW l AS (PARTITION BY row_id ORDER BY k)),
        text AS (SELECT row_id, list(CASE WHEN marker IS NOT NULL THEN marker WHEN next_marker IS NOT NULL AND next_z = 0 AND z = 3 THEN 0 ELSE z END ORDER BY k) AS s FROM e GROUP BY 1),
        joined AS (SELECT row_id, list_concat(list_concat([s], a[2:]), b[2:]) AS m FROM text JOIN v1 USING (row_id))"""
    return {
        "tok14_merge_speakers": f"{merged} {Q.rows('joined', 'row_id')}",
        "tok15_preprocess_tts": f"""{merged}, z AS {Q.parts('joined', 'row_id', 'm', MOST)}, x AS (SELECT row_id, CAST(part AS INTEGER) AS part, {Q.labels(Q.delay('m'))} AS m FROM z WHERE len(m[1]) >= {LEAST}) {Q.rows('x', 'row_id, part')}""",
        # Distances are taken on bytes there: each character of the one side becomes a byte, and all that it lacks one more.
        "str10_error_rate": f"""WITH {P._TURNS}, p AS (SELECT a.doc_id, a.pos, a.text AS r, b.text AS h FROM turns a JOIN turns b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1),
            d AS (SELECT *, list_distinct(string_split(r, '')) AS rc, list_distinct(string_split(h, '')) AS hc FROM p), c AS (SELECT *, CASE WHEN len(rc) <= len(hc) THEN rc ELSE hc END AS cs FROM d),
            m AS (SELECT doc_id, pos, {one_byte('r')} AS r, {one_byte('h')} AS h FROM c)
            SELECT doc_id, pos, round(levenshtein(r, h) / length(r), 9) AS cer FROM m""",
        "stm06_jitter": """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n, value % 40 AS a, 20.0::DOUBLE AS p FROM events),
            r AS (SELECT user_id, 0::BIGINT AS k, 0.0::DOUBLE AS level, 20.0::DOUBLE AS part, 30.0::DOUBLE AS most, 0.0::DOUBLE AS dropped, 0::BIGINT AS underruns, false AS started, 0.0::DOUBLE AS wait FROM (SELECT DISTINCT user_id FROM events)
              UNION ALL SELECT user_id, k, CASE WHEN l2 >= most + part + 80 THEN 80 + part ELSE l2 END, part, CASE WHEN l2 >= most + part + 80 THEN least(80, most + 5) ELSE most END, CASE WHEN l2 >= most + part + 80 THEN dropped + (l2 - (80 + part)) ELSE dropped END,
                underruns, started OR l2 >= 80, CASE WHEN NOT started AND l2 >= 80 THEN part ELSE wait END
              FROM (SELECT user_id, k, level - taken + a AS l2, CASE WHEN plays AND taken < p THEN least(80, part + 5) ELSE part END AS part, most, dropped, underruns + CASE WHEN plays AND taken < p THEN 1 ELSE 0 END AS underruns,
                  started AND NOT (plays AND taken < p) AS started, CASE WHEN plays THEN wait ELSE wait - p END AS wait
                FROM (SELECT *, CASE WHEN plays THEN least(p, level) ELSE 0.0 END AS taken FROM (SELECT r.user_id, e.k, e.a, e.p, r.level, r.part, r.most, r.dropped, r.underruns, r.started, r.wait, r.started AND r.level > 0 AND r.wait <= 0 AS plays FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))))
            SELECT r.user_id, r.level, r.part AS partial, r.most AS maximum, r.dropped, r.underruns, r.started AS playing, r.k AS n FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k WHERE r.k % 10 = 0 OR r.k = e.n""",
        "stm09_text_cursor": f"""WITH {Q.V1}, x AS (SELECT row_id, a[1] AS e, list_filter(b[1], lambda q: q NOT IN (0, 3)) AS t FROM v1), s AS (SELECT row_id, t, unnest(range(len(e))) AS k, unnest(e) AS e FROM x),
            p AS (SELECT *, coalesce(sum(CASE WHEN e NOT IN (0, 3) THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS z FROM s),
            o AS (SELECT row_id, list(CASE WHEN z >= len(t) THEN 3 WHEN e IN (0, 3) THEN e ELSE t[CAST(z AS BIGINT) + 1] END ORDER BY k) AS ids FROM p GROUP BY row_id)
            SELECT row_id, CAST(len(ids) AS INTEGER) AS n, {digest('ids')} AS digest FROM o""",
        "stm09_held_audio": f"""WITH {Q.V1} SELECT row_id, CAST(k - 1 AS INTEGER) AS r, CAST(len(r) AS INTEGER) AS n, {digest('list_transform(r, lambda x, i: CASE WHEN i <= greatest(0, ([0, 1, 2, 3, 1, 1, 1, 4])[k] - 1) THEN 2048 ELSE x END)')} AS digest
            FROM (SELECT row_id, unnest(range(1, 9)) AS k, unnest(a[2:9]) AS r FROM v1)""",
    }
