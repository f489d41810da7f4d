"""Queries of the token-stream operators over dialogue_tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.config import TokenConfig
from turnweave.functions import arrays as X
from turnweave.operators import streams as S
from turnweave.plans import sql as Q

CFG = TokenConfig()
MOST, LEAST = 300, 40


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/dialogue_tokens.parquet")


def sides(spark: SparkSession, d: str) -> DataFrame:
    return S.rectangular_sides(tokens(spark, d)).select("row_id", "A", "B")


def matrix_rows(df: DataFrame, keys: list[str], matrix: Column | str) -> DataFrame:
    """A matrix as rows (keys, r, n, digest): comparable across engines, without nested output."""
    matrix = F.col(matrix) if isinstance(matrix, str) else matrix
    out = df.select(*keys, F.posexplode(matrix).alias("r", "s"))
    return out.select(*keys, "r", F.size("s").alias("n"), X.digest(F.col("s")).alias("digest"))


def main(spark: SparkSession, d: str) -> DataFrame:
    return S.main_speaker_streams(sides(spark, d))


def tok03_merge_text_audio(spark, d):
    rows = tokens(spark, d).where((F.size("A") == 9) & (F.size(F.get("A", F.lit(1))) > 0))
    return matrix_rows(rows, ["row_id"], X.merge_text_audio(F.col("A")))


def tok04_main_speaker(spark, d):
    return matrix_rows(main(spark, d), ["row_id", "speaker_rank"], "streams")


def tok05_delay(spark, d):
    return matrix_rows(main(spark, d), ["row_id", "speaker_rank"], X.delay(F.col("streams")))


def tok06_hashed_delay(spark, d):
    return tokens(spark, d).select("row_id", S.hashed_delay(F.col("row_id"), 4, 7).alias("delay"))


def tok07_undelay(spark, d):
    rows = main(spark, d).withColumn("m", X.undelay(F.col("streams"))).where("m IS NOT NULL")
    return matrix_rows(rows, ["row_id", "speaker_rank"], "m")


def tok08_split(spark, d):
    rows = sides(spark, d).select("row_id", F.posexplode(X.split(F.col("A"), MOST)).alias("part", "m"))
    return matrix_rows(rows, ["row_id", "part"], "m")


def tok09_pack(spark, d):
    grouped = S.pack_groups(sides(spark, d), "row_id", 8)
    return matrix_rows(S.pack(grouped, F.col("pack_group"), "row_id", "A", MOST), ["pack_group", "part"], "streams")


def tok10_labels(spark, d):
    return matrix_rows(main(spark, d), ["row_id", "speaker_rank"], X.labels(X.delay(F.col("streams"))))


def tok11_preprocess_dialogue(spark, d):
    out = S.preprocess_dialogue(sides(spark, d), MOST, LEAST)
    return matrix_rows(out, ["row_id", "speaker_rank", "part", "num_streams", "num_frames"], "labels")


def tok12_preprocess_mono(spark, d):
    return matrix_rows(S.preprocess_mono(sides(spark, d), "A", 2, MOST, LEAST), ["row_id", "part"], "streams")


def tok13_separate_row(spark, d):
    return matrix_rows(sides(spark, d), ["row_id"], X.drop_row(F.col("A"), 1))


def _marked(text: Column) -> Column:
    """The text row with a marker in every 17th cell, 1 and 2 in turn."""
    return F.transform(text, lambda x, i: F.when(i % 17 == 5, F.when(i % 34 == 5, 1).otherwise(2)).otherwise(x))


def tok16_demux(spark, d):
    rows = sides(spark, d).select("row_id", X.demux(_marked(F.get("A", F.lit(0)))).alias("x"))
    return rows.select("row_id", X.digest(F.col("x.main")).alias("main"), X.digest(F.col("x.other")).alias("other"))


def tok17_split_speakers(spark, d):
    rows = main(spark, d).where("speaker_rank = 1").select("row_id", "streams")
    text = X.demux(_marked(F.get("streams", F.lit(0))), True)
    rows = rows.withColumn("x", text)
    a = F.concat(F.array(F.col("x.other")), F.slice("streams", 10, 8))
    return matrix_rows(rows.withColumn("a", a), ["row_id"], "a")


def tok19_prompt_prefix(spark, d):
    role = F.transform(F.sequence(F.lit(1), (F.col("row_id") % 5 + 1).cast("int")), lambda k: (F.col("row_id") % 100 + k).cast("int"))
    rows = sides(spark, d).withColumn("voice", X.cut_time(F.slice("A", 2, 8), 0, 6))
    return matrix_rows(rows, ["row_id"], X.prompt_prefix(role, F.col("voice"), 9))


def _role() -> Column:
    return F.transform(F.sequence(F.lit(1), (F.col("row_id") % 5 + 1).cast("int")), lambda k: (F.col("row_id") % 100 + k).cast("int"))


def tok20_prompt_prefix_v2(spark, d):
    silence = F.array(*[X.ints([10 + k, 20 + k, 30 + k]) for k in range(8)])
    sine = F.array(*[X.ints([40 + k, 50 + k]) for k in range(8)])
    rows = sides(spark, d).withColumn("voice", X.cut_time(F.slice("A", 2, 8), 0, 6))
    return matrix_rows(rows, ["row_id"], X.prompt_prefix_v2(_role(), F.col("voice"), silence, sine, 9))


def tok21_prompted(spark, d):
    out = S.prompted(sides(spark, d), _role(), None, 9, MOST, LEAST)
    return matrix_rows(out, ["row_id", "prompt_len", "num_frames"], "labels")


def tok22_speaker_prefix(spark, d):
    return matrix_rows(main(spark, d), ["row_id", "speaker_rank"], X.speaker_prefix(F.col("streams"), 3, (31_001, 31_002), (2_001, 2_002)))


def tok25_trim(spark, d):
    return sides(spark, d).select("row_id", X.trim_point(F.get("A", F.lit(0)), 5).alias("length"))


def tok26_continuation(spark, d):
    """Frames from 30 up to 120 of both sides; dialogues that end before are left out."""
    rows = sides(spark, d).withColumn("end", F.least(F.lit(120), X.length_of(F.col("A")))).where(F.col("end") > 31)
    return matrix_rows(rows, ["row_id"], X.cut_time(X.main_view(F.col("A"), F.col("B")), 30, F.col("end") - 30))


def tok27_preference_example(spark, d):
    rows = main(spark, d).where("speaker_rank = 0").withColumn("delayed", X.delay(F.col("streams"))).where(X.length_of(F.col("streams")) >= 40)
    out = S.undelayed_continuation(F.col("delayed"), 20, X.cut_time(F.col("streams"), 20, 20))
    return matrix_rows(rows, ["row_id"], X.mask_prompt(X.labels(out), F.lit(20)))


def tok28_question_prompt(spark, d):
    """A is silence, B the question cut or padded to 50 frames; text rows are pads."""
    a = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: X.repeat(F.when(i == 0, 3).otherwise(7), 50))
    b = F.transform(F.col("B"), lambda r, i: F.when(i == 0, X.repeat(3, 50)).otherwise(X.fit(r, F.lit(50), 7)))
    return matrix_rows(sides(spark, d), ["row_id"], F.concat(a, b))


def tok29_voice_prompt(spark, d):
    return matrix_rows(sides(spark, d), ["row_id"], X.cut_time(F.slice("A", 2, 8), 0, 25))


def tok30_swap_channels(spark, d):
    return matrix_rows(main(spark, d).where("speaker_rank = 0").withColumn("m", X.swap_halves(F.slice("streams", 2, 16))), ["row_id"], "m")


def flt03_least_length(spark, d):
    return sides(spark, d).where(X.length_of(F.col("A")) >= 60).select("row_id")


def flt11_misshapen(spark, d):
    return S.misshapen(tokens(spark, d)).groupBy("reason").agg(F.count("*").alias("n"))


def flt13_repair(spark, d):
    """Codes moved out of range in every 10th cell come back as 0."""
    broken = F.transform(F.col("A"), lambda r: F.transform(r, lambda x, i: F.when(i % 10 == 3, x + 2_048).when(i % 10 == 4, -1 - x).otherwise(x)))
    return matrix_rows(sides(spark, d), ["row_id"], X.repair(broken))


def agg05_distinct_ratio(spark, d):
    """Distinct share of the ids of a text row that are neither pad nor end of padding; 0 where there are none."""
    content = F.filter(F.get("A", F.lit(0)), lambda x: ~x.isin(0, 3))
    ratio = F.when(F.size(content) > 0, F.size(F.array_distinct(content)) / F.size(content)).otherwise(0.0)
    return sides(spark, d).select("row_id", F.round(ratio, 9).alias("ratio"))


def agg14_hours(spark, d):
    frames = F.sum(X.length_of(F.col("A")).cast("bigint"))
    return sides(spark, d).agg(F.count("*").alias("n"), frames.alias("frames"), F.round(frames / 12.5 / 3600, 9).alias("hours"))


def bat01_collate(spark, d):
    """Rows of a batch padded with -1 to its longest; the mask is 1 on real frames and -1 on padding."""
    rows = sides(spark, d).select(F.floor(F.col("row_id") / 8).alias("batch_id"), "row_id", X.length_of(F.col("A")).alias("t"), "A")
    longest = rows.groupBy("batch_id").agg(F.max("t").alias("most"))
    rows = rows.join(longest, "batch_id")
    padded = F.transform("A", lambda r: X.fit(r, F.col("most"), -1))
    mask = F.concat(X.repeat(1, F.col("t")), X.repeat(-1, F.col("most") - F.col("t")))
    return matrix_rows(rows, ["batch_id", "row_id"], F.concat(padded, F.array(mask)))


def msk01_pad_weights(spark, d):
    """Sum of audio weights per codebook: 0.5 where the text label, shifted by the relative delay, is a pad, else 1."""
    delays = X.ints(CFG.delays)
    text = F.slice(F.get("m", F.lit(0)), 2, F.size(F.get("m", F.lit(0))) - 1)
    rows = main(spark, d).withColumn("m", X.labels(X.delay(F.col("streams"))))
    rows = rows.withColumn("is_pad", F.transform(text, lambda x: x == 3))
    shift = lambda k: F.get(delays, k)
    sums = F.transform(
        F.sequence(F.lit(1), F.lit(16)),
        lambda k: F.aggregate(
            F.transform("is_pad", lambda _p, t: F.when(F.coalesce(F.when(t >= shift(k), F.get("is_pad", t - shift(k))), F.lit(False)), 0.5).otherwise(1.0)),
            F.lit(0.0),
            lambda s, x: s + x,
        ),
    )
    return rows.select("row_id", "speaker_rank", F.posexplode(sums).alias("codebook", "weight"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:3] in ("tok", "flt", "agg", "bat", "msk") and callable(f) and k[3:5].isdigit()}


def oracle_sql() -> dict[str, str]:
    v, m = f"WITH {Q.V1}", f"WITH {Q.V1}, {Q.MAIN}"
    role = "list_transform(range(1, row_id % 5 + 2), lambda k: CAST(row_id % 100 + k AS INTEGER))"
    marked = lambda t: f"list_transform({t}, lambda x, i: CASE WHEN (i - 1) % 17 = 5 THEN CASE WHEN (i - 1) % 34 = 5 THEN 1 ELSE 2 END ELSE x END)"
    # The speaker at a cell: the last marker at or before it. Markers stand at 5, 22, 39, ... and where the text itself has 1 or 2.
    speaker = "coalesce(list_last(list_filter(x[1:i], lambda y: y IN (1, 2))), 1)"
    dem = lambda who: f"list_transform(x, lambda y, i: CASE WHEN y IN (1, 2) OR {speaker} <> {who} THEN 3 ELSE y END)"
    text = lambda e: f"md5(array_to_string(list_transform({e}, lambda q: CAST(q AS VARCHAR)), ','))"
    voice = "list_transform(a[2:9], lambda r: r[1:6])"
    prefix = lambda tail: f"""list_concat([list_concat(list_concat({Q.rep('3', 'tv')}, role), {tail})], list_transform(range(16), lambda k: CASE WHEN k < 8 THEN list_resize(voice[k + 1], tv + len(role) + 1, 2048) ELSE {Q.rep('2048', 'tv + len(role) + 1')} END))"""
    tile = lambda codes, n: f"list_transform(range({n}), lambda q: {codes}[q % len({codes}) + 1])"
    masked = lambda mat, p: f"list_transform({mat}, lambda r, i: list_transform(r, lambda x, t: CASE WHEN t - 1 < {Q.lst(CFG.delays)}[i] + 1 + {p} THEN -1 ELSE x END))"
    return {
        "tok03_merge_text_audio": f"WITH x AS (SELECT row_id, list_transform(\"A\", lambda r, i: list_resize(r, len(\"A\"[2]), CASE WHEN i = 1 THEN 3 ELSE 2048 END)) AS m FROM dialogue_tokens WHERE len(\"A\") = 9 AND len(\"A\"[2]) > 0) {Q.rows('x', 'row_id')}",
        "tok04_main_speaker": f"{m} {Q.rows('main', 'row_id, speaker_rank')}",
        "tok05_delay": f"{m}, x AS (SELECT row_id, speaker_rank, {Q.delay('m')} AS m FROM main) {Q.rows('x', 'row_id, speaker_rank')}",
        "tok06_hashed_delay": "SELECT row_id, CAST(CAST('0x' || substr(md5(row_id || ':7'), 1, 8) AS BIGINT) % 5 AS INTEGER) AS delay FROM dialogue_tokens",
        "tok07_undelay": f"{m}, x AS (SELECT * FROM (SELECT row_id, speaker_rank, {Q.undelay('m')} AS m FROM main) WHERE m IS NOT NULL) {Q.rows('x', 'row_id, speaker_rank')}",
        "tok08_split": f"{v}, x AS {Q.parts('v1', 'row_id', 'a', MOST)} SELECT row_id, CAST(part AS INTEGER) AS part, r, n, digest FROM ({Q.rows('x', 'row_id, part')})",
        "tok09_pack": f"""{v}, g AS (SELECT *, (row_number() OVER (ORDER BY row_id) - 1) // 8 AS pack_group FROM v1), p AS (
            SELECT pack_group, list_transform(range(1, 10), lambda i: flatten(list_transform(ms, lambda q: q[i]))) AS m FROM (SELECT pack_group, list(a ORDER BY row_id) AS ms FROM g GROUP BY 1)), x AS {Q.parts('p', 'pack_group', 'm', MOST)}
            SELECT pack_group, CAST(part AS INTEGER) AS part, r, n, digest FROM ({Q.rows('x', 'pack_group, part')})""",
        "tok10_labels": f"{m}, x AS (SELECT row_id, speaker_rank, {Q.labels(Q.delay('m'))} AS m FROM main) {Q.rows('x', 'row_id, speaker_rank')}",
        "tok11_preprocess_dialogue": f"""{m}, y AS (SELECT row_id, speaker_rank, {Q.delay('m')} AS m FROM main), z AS {Q.parts('y', 'row_id, speaker_rank', 'm', MOST)},
            x AS (SELECT row_id, speaker_rank, CAST(part AS INTEGER) AS part, CAST(17 AS INTEGER) AS num_streams, CAST(len(m[1]) AS INTEGER) AS num_frames, {Q.labels('m')} AS m FROM z WHERE len(m[1]) >= {LEAST}) {Q.rows('x', 'row_id, speaker_rank, part, num_streams, num_frames')}""",
        "tok12_preprocess_mono": f"""{v}, y AS (SELECT row_id, a, CAST('0x' || substr(md5(row_id || ':0'), 1, 8) AS BIGINT) % 3 AS d FROM v1),
            w AS (SELECT row_id, list_transform(a, lambda r, i: list_concat(list_concat({Q.rep('CASE WHEN i = 1 THEN 32000 ELSE 2048 END', '1 + CASE WHEN i = 1 THEN 0 ELSE d END')}, r), {Q.rep('CASE WHEN i = 1 THEN 3 ELSE 2048 END', '2 - CASE WHEN i = 1 THEN 0 ELSE d END')})) AS m FROM y),
            z AS {Q.parts('w', 'row_id', 'm', MOST)}, x AS (SELECT row_id, CAST(part AS INTEGER) AS part, m FROM z WHERE len(m[1]) >= {LEAST}) {Q.rows('x', 'row_id, part')}""",
        "tok13_separate_row": f"{v}, x AS (SELECT row_id, list_concat(a[1:1], a[3:]) AS m FROM v1) {Q.rows('x', 'row_id')}",
        "tok16_demux": f"{v}, x AS (SELECT row_id, {marked('a[1]')} AS x FROM v1) SELECT row_id, {text(dem(1))} AS main, {text(dem(2))} AS other FROM x",
        "tok17_split_speakers": f"{v}, y AS (SELECT row_id, a, {marked('b[1]')} AS x FROM v1), x AS (SELECT row_id, list_concat([{dem(2)}], a[2:9]) AS m FROM y) {Q.rows('x', 'row_id')}",
        "tok19_prompt_prefix": f"{v}, y AS (SELECT row_id, {role} AS role, {voice} AS voice, least(6, t) AS tv FROM v1), x AS (SELECT row_id, {prefix('[9]')} AS m FROM y) {Q.rows('x', 'row_id')}",
        "tok20_prompt_prefix_v2": f"""{v}, y AS (SELECT row_id, {role} AS role, {voice} AS voice, least(6, t) AS tv FROM v1), z AS (SELECT *, tv + 6 + len(role) + 2 + 6 AS total FROM y),
            x AS (SELECT row_id, list_concat([list_concat(list_concat(list_concat(list_concat({Q.rep('3', 'tv + 6')}, [9]), role), [9]), {Q.rep('3', '6')})],
              list_transform(range(16), lambda k: CASE WHEN k < 8 THEN list_concat(voice[k + 1], ({tile('[10 + k, 20 + k, 30 + k]', 'total')})[tv + 1:]) ELSE {tile('[40 + k - 8, 50 + k - 8]', 'total')} END)) AS m FROM z) {Q.rows('x', 'row_id')}""",
        "tok21_prompted": f"""{v}, y AS (SELECT row_id, list_concat(a, b[2:]) AS m, {role} AS role FROM v1),
            z AS (SELECT row_id, len(role) + 1 AS p, list_transform(m, lambda r, i: (list_concat(CASE WHEN i = 1 THEN list_concat(role, [9]) ELSE {Q.rep('2048', 'len(role) + 1')} END, r))[1:{MOST}]) AS m FROM y),
            w AS (SELECT row_id, p, {Q.delay('m')} AS m FROM z), x AS (SELECT row_id, CAST(p AS INTEGER) AS prompt_len, CAST(len(m[1]) AS INTEGER) AS num_frames, {masked(Q.labels('m'), 'p')} AS m FROM w WHERE len(m[1]) >= {LEAST}) {Q.rows('x', 'row_id, prompt_len, num_frames')}""",
        "tok22_speaker_prefix": f"{m}, x AS (SELECT row_id, speaker_rank, list_transform(m, lambda r, i: list_concat(CASE WHEN i = 1 THEN [31001, 31001, 31001, 31002, 31002, 31002] ELSE [2001, 2001, 2001, 2002, 2002, 2002] END, r)) AS m FROM main) {Q.rows('x', 'row_id, speaker_rank')}",
        "tok25_trim": f"{v}, y AS (SELECT row_id, t, list_max(list_filter(range(t), lambda k: a[1][k + 1] <> 3)) AS l FROM v1) SELECT row_id, CAST(CASE WHEN l >= t - 5 THEN t ELSE coalesce(l + 5, least(4, t - 1)) END AS INTEGER) AS length FROM y",
        "tok26_continuation": f"{v}, x AS (SELECT row_id, list_transform(list_concat(a, b[2:]), lambda r: r[31:least(120, t)]) AS m FROM v1 WHERE least(120, t) > 31) {Q.rows('x', 'row_id')}",
        "tok27_preference_example": f"{m}, y AS (SELECT row_id, {Q.delay('list_transform(m, lambda r: r[1:40])')} AS m FROM main WHERE speaker_rank = 0 AND len(m[1]) >= 40), x AS (SELECT row_id, {masked(Q.labels('m'), '20')} AS m FROM y) {Q.rows('x', 'row_id')}",
        "tok28_question_prompt": f"{v}, x AS (SELECT row_id, list_concat(list_transform(range(9), lambda i: {Q.rep('CASE WHEN i = 0 THEN 3 ELSE 7 END', '50')}), list_transform(b, lambda r, i: CASE WHEN i = 1 THEN {Q.rep('3', '50')} ELSE list_resize(r, 50, 7) END)) AS m FROM v1) {Q.rows('x', 'row_id')}",
        "tok29_voice_prompt": f"{v}, x AS (SELECT row_id, list_transform(a[2:9], lambda r: r[1:25]) AS m FROM v1) {Q.rows('x', 'row_id')}",
        "tok30_swap_channels": f"{v}, x AS (SELECT row_id, list_concat(b[2:9], a[2:9]) AS m FROM v1) {Q.rows('x', 'row_id')}",
        "flt03_least_length": f"{v} SELECT row_id FROM v1 WHERE t >= 60",
        "flt11_misshapen": """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN "A" IS NULL OR "B" IS NULL THEN 'null side' WHEN len("A") = 0 OR len("B") = 0 THEN 'empty side' WHEN len("A") <> 9 OR len("B") <> 9 THEN 'wrong number of streams'
            WHEN coalesce(len("A"[2]), 0) = 0 OR coalesce(len("B"[2]), 0) = 0 THEN 'no audio' END AS reason FROM dialogue_tokens) WHERE reason IS NOT NULL GROUP BY 1""",
        "flt13_repair": f"{v}, y AS (SELECT row_id, list_transform(a, lambda r: list_transform(r, lambda x, i: CASE WHEN (i - 1) % 10 = 3 THEN x + 2048 WHEN (i - 1) % 10 = 4 THEN -1 - x ELSE x END)) AS m FROM v1), x AS (SELECT row_id, list_transform(m, lambda r, i: CASE WHEN i = 1 THEN r ELSE list_transform(r, lambda x: CASE WHEN x < 0 OR x >= 2048 THEN 0 ELSE x END) END) AS m FROM y) {Q.rows('x', 'row_id')}",
        "agg05_distinct_ratio": f"{v} SELECT row_id, round(CASE WHEN len(f) > 0 THEN len(list_distinct(f)) / len(f) ELSE 0.0 END, 9) AS ratio FROM (SELECT row_id, list_filter(a[1], lambda x: x NOT IN (0, 3)) AS f FROM v1)",
        "agg14_hours": f"{v} SELECT count(*) AS n, CAST(sum(t) AS BIGINT) AS frames, round(sum(t) / 12.5 / 3600, 9) AS hours FROM v1",
        "bat01_collate": f"{v}, y AS (SELECT row_id // 8 AS batch_id, row_id, t, a, max(t) OVER (PARTITION BY row_id // 8) AS most FROM v1), x AS (SELECT batch_id, row_id, list_concat(list_transform(a, lambda r: list_resize(r, most, -1)), [list_concat({Q.rep('1', 't')}, {Q.rep('-1', 'most - t')})]) AS m FROM y) {Q.rows('x', 'batch_id, row_id')}",
        "msk01_pad_weights": f"""{m}, y AS (SELECT row_id, speaker_rank, list_transform(({Q.labels(Q.delay('m'))})[1][2:], lambda x: x = 3) AS p FROM main)
            SELECT row_id, speaker_rank, CAST(c AS INTEGER) AS codebook, list_sum(list_transform(p, lambda q, t: CASE WHEN t - {Q.lst(CFG.delays)}[c + 2] >= 1 AND p[t - {Q.lst(CFG.delays)}[c + 2]] THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END)) AS weight
            FROM (SELECT *, unnest(range(16)) AS c FROM y)""",
    }
