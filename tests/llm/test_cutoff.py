import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from turnweave.llm import cutoff

SCHEMA = "rec_id long, stem string, cer double, shard int, scored_at timestamp_ntz, source string, cutoff string"


def _at(k):
    return dt.datetime(2025, 1, 1) + dt.timedelta(seconds=k)


def test_stems(spark):
    cases = {"wavs\\Polite_Ask_x_1.WAV ": "polite_ask_x_1", "./a/b_c.json": "b_c", "pool/É_x_1": "é_x_1", " a_b ": "a_b", "a.b_c.1": "a.b_c.1", "": "", "x/": ""}
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", cutoff.clean_stem(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in rows} == cases


@pytest.mark.parametrize("error,k", [(None, 800), (0.0, 8)])
def test_cutoffs_are_exact(spark, monkeypatch, error, k):
    if error is not None:  # a bracket that misses
        monkeypatch.setattr(cutoff, "rank_error", lambda k: error)
    rng, rows = random.Random(2), []
    for i in range(6_000):
        source = rng.choice(["hot_a", "hot_a", "hot_a", "b_c", "d"])
        cer = rng.choice([round(rng.random(), 3), 0.4, 0.5, 0.0, None, float("nan"), float("inf"), -1.0])
        rows.append((i, f"{source}_{rng.randint(0, 3000)}", cer, 0, _at(rng.randint(0, 500)), "clash", "clash"))
    rows += [(9_000, None, 0.1, 0, _at(1), None, None), (9_001, "one_only_x", 0.3, 0, None, None, None)]
    latest = {}
    for i, stem, cer, _, at, *_ in rows:
        if stem is not None:
            latest[stem] = max(latest.get(stem, ((_at(-1),),)), ((at or _at(-1), i), cer), key=lambda x: x[0])
    by = {}
    for stem, (_, cer) in latest.items():
        if cer is not None and math.isfinite(cer) and cer >= 0:
            by.setdefault("_".join(stem.split("_")[:2]), []).append((cer, stem))
    want, keep = {}, set()
    for source, values in by.items():
        values.sort()
        need = -(-80 * len(values) // 100)
        cut = values[need - 1][0]
        chosen = {s for c, s in values if c <= cut}
        want[source] = (cut, len(values), len(chosen))
        keep |= chosen
    records = cutoff.counted(spark.createDataFrame(rows, SCHEMA))
    found = cutoff.cutoffs(records, 80, k)
    assert {r.source: (r.cutoff, r.n_records, r.n_kept) for r in found.collect()} == want
    assert {r.stem for r in cutoff.kept(records, found).collect()} == keep


def test_empty(spark):
    records = cutoff.counted(spark.createDataFrame([], SCHEMA))
    assert cutoff.cutoffs(records).count() == 0


def test_a_hot_source_is_dealt_out(spark):
    """70 % of the rows in one source: records meet what is known of it by source and salt only."""
    rows = spark.range(4_000).select(F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"), F.col("id").cast("string").alias("stem"), (F.col("id") % 997 / 997.0).alias("cer"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = cutoff.cutoffs(rows)
        kept = cutoff.kept(rows, found)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin [source") == 3 and plan.count(", _salt") >= 3
        for line in plan.splitlines():
            if "Join" in line:
                assert "_salt" in line
        per = {r.source: r for r in found.collect()}
        assert per["hot"].n_records == 2_800 and 2_240 <= per["hot"].n_kept < 2_250
        assert kept.count() == sum(r.n_kept for r in per.values())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
