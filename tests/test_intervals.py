import random

import pytest
from pyspark.sql import functions as F

from turnweave.functions.labels import label_key, usable
from turnweave.operators import intervals as I


def _brute(rows):
    by = {}
    for e, p, s, t in rows:
        if s is not None and t is not None and t > s:
            by.setdefault((e, p), []).append((s, t))
    periods, gaps = set(), set()
    for key, spans in by.items():
        spans.sort()
        low, high = spans[0]
        for s, t in spans[1:]:
            if s > high:
                periods.add((*key, low, high))
                gaps.add((*key, high, s))
                low = s
            high = max(high, t)
        periods.add((*key, low, high))
    return periods, gaps


@pytest.mark.parametrize("block,batch", [(600_000, 10_000), (50, 10_000), (7, 16), (400, 3)])
def test_against_brute_force(spark, block, batch):
    rng = random.Random(block)
    rows = []
    for _ in range(900):
        s = rng.choice([rng.randint(-500, 9_000), rng.randint(0, 300)])
        rows.append((rng.choice(["hot", "hot", "hot", "b", None]), rng.choice(["A", "B", None]), rng.choice([s, s, s, None]), s + rng.choice([-5, 0, 1, 3, 10, 400, 2_000])))
    rows += rows[:40] + [("t", "A", 0, 5), ("t", "A", 5, 9), ("t", "A", 2, 3), ("t", "A", 12, 13)]
    periods, gaps = _brute(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        frame = spark.createDataFrame([(*r, "x") for r in rows], "e string, p string, s long, t long, block string").repartition(5)
        states = I.interval_states(frame, *map(F.col, "epst"), block_ms=block)
        assert {tuple(r) for r in I.periods(states).collect()} == periods
        found = I.gaps(states).collect()
        assert {tuple(r) for r in found} == gaps and len(found) == len(gaps)
        assert {tuple(r) for r in I.gaps(states, 10, 100).collect()} == {g for g in gaps if 10 <= g[3] - g[2] <= 100}
        assert I.periods(I.interval_states(frame.limit(0), *map(F.col, "epst"))).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_labels(spark):
    names = {
        "A": "a", "Ａ": "a", " A　": "a", "**A**": "a", "А": "a", "Speaker:a": "a", "SPK_A": "a", "spk A": "a", "A -": "a", "Speaker-S1:": "s1", "S 1": "s1", "Ѕ1": "s1",
        "ch.2": "ch2", "ｃｈ＿１": "ch1", "c﻿h_2": "ch2", "ЅYЅТΕМ": "system", "A/B": "ab", "": "", "-": "", None: None,
    }
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", label_key(F.col("n")).alias("k")).collect()
    assert {r.n: r.k for r in rows} == names


def test_usable_rows(spark):
    rows = [(1, "A", 0.0, 1.0), (2, "S1", 1.0, 1.0), (3, "both", 0.0, 1.0), (4, None, 0.0, 1.0), (5, "a:", None, 1.0), (6, "ch_2", 0.0, float("nan")), (7, "ch-2", 0.0004, 0.0016), (8, "X", 0.0, 1.0), (9, "twice", 0.0, 1.0), (10, "B", 0.0, float("inf"))]
    words = spark.createDataFrame([(*r, "clash") for r in rows], "row_id long, speaker string, start double, end double, channel string")
    roles = spark.createDataFrame([("A", "A"), ("S1", "A"), ("ch_2", "B"), ("B", "B"), ("twice", "A"), ("Twice", "B"), (None, "A")], "role string, channel string")
    out = usable(words, roles).select("row_id", "channel", "start_ms", "end_ms").collect()
    assert {tuple(r) for r in out} == {(1, "A", 0, 1000), (7, "B", 0, 2)}
