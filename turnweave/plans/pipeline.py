"""Queries of the remaining scans, sinks, joins and collators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions import arrays as X
from turnweave.functions import text as T
from turnweave.operators import batching as B
from turnweave.operators import corpus as C
from turnweave.plans.corpus import docs, read, turns
from turnweave.plans.token_streams import sides


def src08_named_parquet(spark, d):
    """Several paths as one table, with the columns asked for."""
    return spark.read.parquet(f"{d}/orders.parquet", f"{d}/orders.parquet").select("o_orderkey", "o_totalprice").groupBy((F.col("o_orderkey") % 10).alias("k")).agg(F.count("*").alias("n"))


def src19_speaker_pairs(spark, d):
    """Dialogues with segments of both speakers; segments with bad or missing spans are dropped first."""
    w = read(spark, d, "word_transcripts").select("dialogue_id", "speaker", F.try_to_number(F.col("start").cast("string"), F.lit("999999.999")).alias("s"), "start", "end").where("start IS NOT NULL AND `end` > start")
    side = lambda who, name: w.where(F.col("speaker") == who).groupBy("dialogue_id").agg(F.count("*").alias(name))
    return side("A", "n_a").join(side("B", "n_b"), "dialogue_id")


def src22_merge_scores(spark, d):
    """Scores of all shards in one table, blank lines skipped."""
    rows = read(spark, d, "cer_all").select(F.to_json(F.struct("stem", "cer")).alias("line"), "shard").where("trim(line) <> ''")
    parsed = rows.select("shard", F.from_json("line", "stem string, cer double").alias("x"))
    return parsed.groupBy("shard").agg(F.count("*").alias("n"), F.count("x.stem").alias("n_stems"))


def snk04_json_lines(spark, d):
    return read(spark, d, "documents").select("doc_id", F.to_json(F.struct("doc_id", "form")).alias("line"))


def snk06_manifest(spark, d):
    return read(spark, d, "dialogues").select(F.concat_ws(",", "dialogue_id", "lang", "source").alias("line")).distinct()


def snk07_chunk_names(spark, d):
    out = C.greedy_chunks(C.merge_turns(turns(spark, d)), 150)
    return out.groupBy(C.chunk_names(F.col("doc_id").cast("string"), F.col("chunk")).alias("name")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def flt01_drop_columns(spark, d):
    return read(spark, d, "documents").drop("text", "lang", "source", "n_chars", "added_at")


def jn02_missing_both_ways(spark, d):
    a, b = read(spark, d, "dialogue_tokens"), read(spark, d, "word_transcripts")
    left = C.missing(a, b, "dialogue_id").select("dialogue_id", F.lit("right").alias("lacks"))
    return left.unionByName(C.missing(b, a, "dialogue_id").select("dialogue_id", F.lit("left").alias("lacks")))


def jn10_both_directions(spark, d):
    """Each dialogue as (main, other) both ways, without a shuffle."""
    rows = sides(spark, d).withColumn("main", F.explode(F.array(F.lit("A"), F.lit("B"))))
    first = F.when(F.col("main") == "A", F.col("A")).otherwise(F.col("B"))
    return rows.select("row_id", "main", X.digest(F.get(first, F.lit(0))).alias("digest"))


def bat02_typed_collate(spark, d):
    """Batches of 16 texts as padded ids, mask (0 on padding) and labels whose prompt cells are ignored."""
    code = F.transform(T.chars(F.col("text")), lambda c: F.ascii(c) % 31_996 + 4)
    rows = docs(spark, d).where("text <> ''").select(F.floor(F.col("doc_id") / 16).alias("batch_id"), "doc_id", code.alias("ids"), (F.col("doc_id") % 9).cast("int").alias("prompt_len"))
    out = B.collate_text(rows, "batch_id", "ids", "prompt_len")
    return out.select("batch_id", "doc_id", *[X.digest(F.col(c)).alias(c) for c in ("ids", "mask", "labels")])


def stm02_receive(spark, d):
    """How many messages are taken, and how many are turned away for which reason."""
    from turnweave.streaming import live

    kind = (F.col("event_id") % 9).cast("int")
    m = F.when(F.col("event_id") % 10 == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.concat(F.lpad(F.hex(kind), 2, "0"), F.lit("61"))))
    rows = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 11 != 0, m).alias("message"))
    taken = live.accepted(rows).groupBy(F.lit("accepted").alias("reason")).agg(F.count("*").alias("n"))
    return taken.unionByName(live.rejected(rows).groupBy("reason").agg(F.count("*").alias("n")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if re.match(r"[a-z]{2,3}\d\d_", k)}


def oracle_sql() -> dict[str, str]:
    from turnweave.plans import corpus as P
    from turnweave.plans import sql as Q

    digest = lambda a: f"md5(array_to_string(list_transform({a}, lambda q: CAST(q AS VARCHAR)), ','))"
    b = 150
    return {
        "src08_named_parquet": "SELECT o_orderkey % 10 AS k, 2 * count(*) AS n FROM orders GROUP BY 1",
        "src19_speaker_pairs": """SELECT * FROM (SELECT dialogue_id, count(*) AS n_a FROM word_transcripts WHERE speaker = 'A' AND "end" > start GROUP BY 1) JOIN (SELECT dialogue_id, count(*) AS n_b FROM word_transcripts WHERE speaker = 'B' AND "end" > start GROUP BY 1) USING (dialogue_id)""",
        "src22_merge_scores": "SELECT shard, count(*) AS n, count(stem) AS n_stems FROM cer_all GROUP BY 1",
        "snk04_json_lines": """SELECT doc_id, '{"doc_id":' || doc_id || ',"form":"' || form || '"}' AS line FROM documents""",
        "snk06_manifest": "SELECT DISTINCT concat_ws(',', dialogue_id, lang, source) AS line FROM dialogues",
        "snk07_chunk_names": f"""WITH RECURSIVE {P._TURNS}, {P._MERGED}, k AS MATERIALIZED (SELECT doc_id, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM merged),
            r AS (SELECT doc_id, i, n, n AS used, 0 AS chunk FROM k WHERE i = 1 UNION ALL
              SELECT k.doc_id, k.i, k.n, CASE WHEN r.used + k.n > {b} THEN k.n ELSE r.used + k.n END, r.chunk + CASE WHEN r.used + k.n > {b} THEN 1 ELSE 0 END FROM r JOIN k ON k.doc_id = r.doc_id AND k.i = r.i + 1)
            SELECT format('{{}}_part{{:02d}}', doc_id, chunk) AS name, count(*) AS n, CAST(sum(n) AS BIGINT) AS chars FROM r GROUP BY 1""",
        "flt01_drop_columns": "SELECT doc_id, form FROM documents",
        "jn02_missing_both_ways": "WITH a AS (SELECT DISTINCT dialogue_id FROM dialogue_tokens), b AS (SELECT DISTINCT dialogue_id FROM word_transcripts) SELECT dialogue_id, 'right' AS lacks FROM a WHERE dialogue_id NOT IN (SELECT * FROM b) UNION ALL SELECT dialogue_id, 'left' FROM b WHERE dialogue_id NOT IN (SELECT * FROM a)",
        "jn10_both_directions": f"WITH {Q.V1} SELECT row_id, 'A' AS main, {digest('a[1]')} AS digest FROM v1 UNION ALL SELECT row_id, 'B', {digest('b[1]')} FROM v1",
        "bat02_typed_collate": f"""WITH x AS (SELECT doc_id // 16 AS batch_id, doc_id, list_transform(string_split(text, ''), lambda c: unicode(c) % 31996 + 4) AS x, doc_id % 9 AS p FROM documents WHERE text <> ''), y AS (SELECT *, max(len(x)) OVER (PARTITION BY batch_id) AS most FROM x)
            SELECT batch_id, doc_id, {digest('list_resize(x, most, -1)')} AS ids, {digest('list_transform(range(most), lambda i: CASE WHEN i < len(x) THEN 1 ELSE 0 END)')} AS mask, {digest('list_transform(list_resize(x, most, -1), lambda v, i: CASE WHEN i <= p THEN -1 ELSE v END)')} AS labels FROM y""",
        "stm02_receive": "SELECT CASE WHEN event_id % 11 = 0 THEN 'not binary' WHEN event_id % 10 = 0 THEN 'empty' WHEN event_id % 9 = 1 THEN 'accepted' ELSE (['handshake', 'audio', 'text', 'control', 'metadata', 'error', 'ping', 'coloured', 'unknown'])[event_id % 9 + 1] END AS reason, count(*) AS n FROM events GROUP BY 1",
    }
