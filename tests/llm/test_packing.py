import itertools
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from turnweave.llm import packing

SCHEMA = "row_id long, dialogue_id string, A array<array<int>>, B array<array<int>>, exported_at timestamp_ntz, frames string"


def _least(sizes, capacity):
    for n in range(1, len(sizes) + 1):
        for where in itertools.product(range(n), repeat=len(sizes)):
            fill = [0] * n
            for w, s in zip(where, sizes):
                fill[w] += s
            if max(fill) <= capacity:
                return n
    return 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=6))
def test_bound_and_packing_enclose_the_optimum(sizes):
    best = _least(sizes, 20)
    at = packing.best_fit_decreasing(sizes, 20)
    assert packing.lower_bound(sizes, 20) <= best <= len(set(at))
    fill = defaultdict(int)
    for k, s in zip(at, sizes):
        fill[k] += s
    assert all(v <= 20 for v in fill.values())


def test_dialogues(spark):
    import datetime as dt

    t = [dt.datetime(2025, 1, d) for d in (1, 2)]
    rows = [
        (1, "a", [[1] * 5, [1] * 9], None, t[0], "x"), (2, "a", [[1] * 30], [], t[1], "x"), (3, "a", [[1] * 30], [], t[1], "x"), (4, "b", None, None, t[0], "x"),
        (5, "c", [None, [1, 2]], [[1] * 12], t[0], "x"), (6, "d", [[1] * 20], [], None, "x"), (7, "e", [], [[]], t[0], "x"), (8, "f", [[1] * 10], [[1] * 8], t[0], "x"),
    ]
    tokens = spark.createDataFrame(rows, SCHEMA)
    packed = packing.pack_dialogues(tokens, 10).collect()
    assert sorted((r.dialogue_id, r.part, r.n_parts, r.frames) for r in packed) == [
        ("a", 1, 3, 10), ("a", 2, 3, 10), ("a", 3, 3, 10), ("c", 1, 2, 10), ("c", 2, 2, 2), ("d", 1, 2, 10), ("d", 2, 2, 10), ("f", 1, 1, 10)
    ]
    fill = defaultdict(int)
    for r in packed:
        fill[r.container] += r.frames
    assert max(fill.values()) <= 10 and None not in fill
    assert {r.dialogue_id for r in packing.split_dialogues(packing.pack_dialogues(tokens, 10)).collect()} == {"a", "c", "d"}
    assert packing.pack_dialogues(tokens.limit(0), 10).count() == 0


def test_exchange_rounds_keep_every_item(spark):
    items = spark.range(3_000).selectExpr("cast(id as string) dialogue_id", "1L part", "1 + (id * 7919) % 700 as frames")
    packed = packing.pack(items, 1000, groups=64, rounds=3).collect()
    assert len(packed) == 3_000 and all(r.container for r in packed)
    fill = defaultdict(int)
    for r in packed:
        fill[r.container] += r.frames
    total = sum(fill.values())
    assert max(fill.values()) <= 1000 and len(fill) <= 1.03 * (-(-total // 1000))
