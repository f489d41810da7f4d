"""Token streams against plain Python models and algebraic laws, and golden cases of the folds."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnweave.config import TokenConfig
from turnweave.functions import arrays as X
from turnweave.functions.tokenizer import CodePoints
from turnweave.operators import align
from turnweave.operators import streams as S

CFG = TokenConfig()
SMALL = TokenConfig(codebooks=1, delays=(0, 0, 1), text_initial=100, audio_initial=50)


def one(spark, matrix, make, schema="m array<array<int>>"):
    return spark.createDataFrame([(matrix,)], schema).select(make(F.col("m")).alias("x")).first().x


def test_delay_and_back(spark):
    m = [[7, 8, 9], [1, 2, 3], [4, 5, 6]]
    delayed = one(spark, m, lambda c: X.delay(c, SMALL))
    assert delayed == [[100, 7, 8, 9, 3], [50, 1, 2, 3, 50], [50, 50, 4, 5, 6]]
    back = one(spark, delayed, lambda c: X.undelay(c, SMALL.delays))
    assert [r[1:] for r in back] == m
    assert one(spark, [[1], [1], [1]], lambda c: X.undelay(c, SMALL.delays)) is None
    assert one(spark, delayed, lambda c: X.labels(c, SMALL)) == [[-1, 7, 8, 9, 3], [-1, 1, 2, 3, -1], [-1, -1, 4, 5, 6]]
    assert one(spark, [[99, 100, 101], [49, 50, 51], [0, 0, 0]], lambda c: X.labels(c, SMALL)) == [[99, -1, -1], [49, -1, -1], [0, 0, 0]]


def test_split_law(spark):
    rows = [([list(range(n))],) for n in range(0, 40)]
    out = spark.createDataFrame(rows, "m array<array<int>>").select("m", X.split(F.col("m"), 3).alias("p")).collect()
    for r in out:
        sizes = [len(p[0]) for p in r.p]
        assert [x for p in r.p for x in p[0]] == r.m[0] and len(sizes) == -(-len(r.m[0]) // 3)
        assert not sizes or (max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True))
    assert [len(p[0]) for p in out[10].p] == [3, 3, 2, 2]


def test_nulls_and_empties(spark):
    rows = [(1, "d", None, None, None), (2, "d", [], [], None), (3, "d", [[1]] * 9, [[]] * 9, None), (4, "d", [[1, 2]] * 8, [[1]] * 9, None), (5, "d", [[]] + [[5, 6]] * 8, [[9, 9, 9]] + [[7]] * 8, "clash")]
    tokens = spark.createDataFrame(rows, "row_id long, dialogue_id string, A array<array<int>>, B array<array<int>>, streams string")
    sides = S.rectangular_sides(tokens)
    assert [(r.row_id, r.A[0], r.A[1], r.B[0]) for r in sides.collect()] == [(5, [3], [5], [9])]
    assert {(r.row_id, r.reason) for r in S.misshapen(tokens).collect()} == {(1, "null side"), (2, "empty side"), (3, "no audio"), (4, "wrong number of streams")}
    assert S.main_speaker_streams(sides.drop("streams")).count() == 2
    assert S.preprocess_dialogue(sides.drop("streams"), 10, 1).count() == 2
    with pytest.raises(Exception, match="empty system prompt"):
        one(spark, [[1]], lambda c: X.prompt_prefix(F.array().cast("array<int>"), None, None))


def _trim(tokens, buffer):
    if any(t != 3 for t in tokens[-buffer:]):
        return len(tokens)
    i = None
    for i in reversed(range(len(tokens))):
        if i < buffer:
            break
        if tokens[i - buffer] != 3:
            return i
    return i


def test_trim(spark):
    import itertools

    rows = [(list(t),) for n in range(1, 7) for t in itertools.product((3, 5), repeat=n)]
    for buffer in (1, 2, 4):
        out = spark.createDataFrame(rows, "t array<int>").select("t", X.trim_point(F.col("t"), buffer).alias("n")).collect()
        assert all(r.n == _trim(r.t, buffer) for r in out)


def test_float_frames(spark):
    out = spark.range(0, 300_000, 7).select((F.col("id") / 1000).alias("t")).select("t", X.float_frame(F.col("t")).alias("f")).collect()
    assert all(r.f == int(r.t // (1 / 12.5)) for r in out)
    assert 0.24 // 0.08 == 2


def test_demux_golden(spark):
    text = [5, 1, 0, 6, 2, 7, 3, 0]
    make = lambda first: one(spark, text, lambda c: X.demux(c, first), "m array<int>")
    assert make(True).main == [5, 3, 0, 6, 3, 3, 3, 3] and make(True).other == [3, 3, 3, 3, 3, 7, 3, 0]
    assert make(False).main == [3, 3, 0, 6, 3, 3, 3, 3] and make(False).other == [5, 3, 3, 3, 3, 7, 3, 0]


@pytest.mark.parametrize(
    "main,other,merged",
    [
        ([3, 3, 0, 9], [3, 3, 3, 3], [3, 0, 1, 9]),
        ([3, 3, 3, 3], [9, 8, 3, 3], [2, 8, 3, 3]),
        ([9, 8], [3, 3], [1, 8]),
        ([3, 9, 3, 3], [3, 3, 8, 3], [1, 9, 3, 3]),
        ([3, 3, 9], [3, 8, 7], [2, 1, 9]),
        ([3, 0, 9, 3, 0, 3], [3, 3, 3, 3, 3, 8], [0, 1, 9, 0, 2, 8]),
        ([], [], []),
    ],
)
def test_merge_golden(main, other, merged):
    assert align.merge_speakers(main, other) == merged


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 3, 3, 3, 7]), st.sampled_from([0, 3, 3, 3, 8])), max_size=30))
def test_merge_keeps_length_and_marks_in_turn(frames):
    out = align.merge_speakers([a for a, _ in frames], [b for _, b in frames])
    marks = [x for x in out if x in (1, 2)]
    assert len(out) == len(frames) and all(a != b for a, b in zip(marks, marks[1:]))


def _placed(pieces):
    starts, ids = np.array([s for s, _, _ in pieces], dtype=float), np.array([i for _, _, i in pieces])
    return align.place_pieces(starts, pieces[-1][1] if pieces else 0.0, ids, 12.5, 3, 0)


def test_placing_golden():
    assert _placed([(0.0, 0.1, 7), (0.01, 0.2, 8), (0.4, 0.5, 9)])[0][:7] == [7, 8, 3, 3, 0, 9, 3]
    assert _placed([(0.24, 0.3, 7)])[0][:4] == [3, 0, 7, 3]
    assert _placed([(0.5, 0.1, 7), (5.0, 0.1, 8), (0.2, 0.1, 9)]) == ([3, 3, 3, 3, 3, 0, 7] + [3] * 6, 2)
    assert _placed([]) == ([], 0)
    t = CodePoints()
    ids, dropped, error = align.align_words([("ab", 0.0, 0.16), ("c", 0.5, 0.6)], t, True, False)
    assert (ids[:3], dropped, error) == ([t.piece_to_id("a"), t.piece_to_id("b"), 3], 0, None) and t.piece_to_id("c") in ids
    assert align.align_words([("", 0.0, 1.0)], t, False, False)[2] == "empty word"
    assert align.align_words([("", 0.0, 1.0)], t, False, True) == ([], 0, None)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(4, 9)), max_size=12))
def test_placing_takes_the_first_free_frame(wishes):
    """Against the definition: each id on the first frame from its own on that holds no id and no end-of-padding id."""
    starts = [(f + 0.5) * 0.08 for f, _ in wishes]
    found, dropped = _placed([(s, 0.9, i) for s, (_, i) in zip(starts, wishes)])
    cells, left = [3] * (int((0.9 + 1) * 12.5) if wishes else 0), 0
    for k, (frame, piece) in enumerate(wishes):
        free = [c for c in range(frame, len(cells)) if cells[c] == 3]
        if not free:
            left = len(wishes) - k
            break
        cells[free[0]] = piece
        if free[0] and cells[free[0] - 1] == 3:
            cells[free[0] - 1] = 0
    assert (found, dropped) == (cells, left)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 3, 3, 7]), st.sampled_from([0, 3, 3, 8])), max_size=24))
def test_markers_stand_before_each_change(frames):
    main, other = [a for a, _ in frames], [b for _, b in frames]
    out = align.merge_speakers(main, other)
    for t, x in enumerate(out):
        if x == 7:
            assert main[t] == 7
        if x == 8:
            assert other[t] == 8 and main[t] in (0, 3)
    # Between an id of one speaker and the next id of the other stands a marker of the latter, unless no cell lies before it.
    spoken = [(t, x) for t, x in enumerate(out) if x not in (0, 3)]
    for (_, x), (_, y) in zip(spoken, spoken[1:]):
        if y == 8 and x != 8:
            assert x == 2
        if y == 7 and x == 8:
            raise AssertionError("no marker of the main speaker")


def test_frame_align_frame(spark):
    rows = [("d", "A", "hi", 0.0, 0.2, 2, "x"), ("d", "A", "a", None, 0.2, 1, "x"), ("d", "B", " yo ", 0.3, 0.4, 3, "x"), ("e", "A", None, 0.0, 0.4, 4, "x")]
    words = spark.createDataFrame(rows, "dialogue_id string, channel string, word string, start double, end double, row_id long, ids string")
    out = {(r.dialogue_id, r.channel): (len(r.ids), r.error) for r in align.frame_align(words).collect()}
    assert out == {("d", "A"): (15, None), ("d", "B"): (17, None), ("e", "A"): (0, "empty word")}
    assert align.frame_align(words.limit(0)).count() == 0


def test_numbering_is_global(spark):
    rows = spark.range(1000).selectExpr("id * 7919 % 1000 as v", "'x' as clash").repartition(7)
    out = S.number_rows(rows, [F.col("v")], "k").collect()
    assert len(out) == 1000 and all(r.k == r.v for r in out)
