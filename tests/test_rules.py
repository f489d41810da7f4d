"""Golden cases and brute force for rules that the test tables exercise little."""

import math
import random
import statistics
from collections import defaultdict

from pyspark.sql import functions as F

from turnweave.functions import arrays as X
from turnweave.functions import text as T
from turnweave.functions.tokenizer import SentencePiece
from turnweave.operators import corpus as C
from turnweave.operators import scores as S


def test_parse_dialogue(spark):
    rows = [
        (1, "assistant: A: はい。\nB： ええ \n\nC: no\nＡ: そうです"), (2, "A: one.\r\nB: two!"), (3, "analysisA: x。"), (4, None), (5, ""), (6, "final\n  B:  最後…  "), (7, "A:\nB: end"),
    ]
    found = sorted((r.doc_id, r.speaker, r.text) for r in C.parse_dialogue(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # The last turn must end like a sentence; a role word runs up to a word's end.
    assert found == [(1, "S1", "はい。"), (1, "S2", "ええ"), (2, "S1", "one."), (2, "S2", "two!"), (6, "S2", "最後…")]


def test_single_speaker_and_spans(spark):
    rows = spark.createDataFrame([("a", "A"), ("a", "A"), ("b", "A"), ("b", "B"), ("c", None)], "k string, speaker string")
    assert {(r.k, r.speaker, r.problem) for r in C.single_speaker(rows, "k").collect()} == {("a", "A", None), ("b", None, "several speakers"), ("c", None, None)}
    spans = spark.createDataFrame([(1, 0), (1, 5), (2, 0)], "k long, start int")
    expected = spark.createDataFrame([(1, 2), (2, 3)], "k long, n_turns int")
    assert sorted(r.start for r in C.recovered_spans(spans, "k", expected).collect()) == [0, 5]


def test_sparse_json_and_object_or_text(spark):
    df = spark.createDataFrame([(None, {}, [])], "a string, m map<string,int>, l array<string>")
    assert df.select(T.sparse_json({c: F.col(c) for c in df.columns}).alias("j")).first().j == "{}"
    df = spark.createDataFrame([('x"y', {"k": 1}, ["a"])], "a string, m map<string,int>, l array<string>")
    assert df.select(T.sparse_json({c: F.col(c) for c in df.columns}).alias("j")).first().j == '{"a":"x\\"y","m":{"k":1},"l":["a"]}'
    docs = ['{"p": {"a": 1}}', '{"p": "{\\"a\\": 1}"}', '{"p": {}}', '{"p": null}', '{"p": "{bad"}', "{}", "broken", None, '{"p": [1]}']
    rows = spark.createDataFrame([(d,) for d in docs], "d string").select(F.get_json_object(T.object_or_text("d", "p"), "$.a").alias("a")).collect()
    assert [r.a for r in rows] == ["1", "1", None, None, None, None, None, None, None]


def test_losses(spark):
    li = spark.createDataFrame([(5, 0, 1.0), (-1, 0, 9.0), (5, 3, 2.0), (5, 8, 4.0), (5, 12, 8.0)], "label int, codebook int, loss double")
    assert S.weighted_audio_loss(li).first().audio_loss == (100 * 1 + 2) / 101
    assert S.weighted_audio_loss(li, user_stream=True).first().audio_loss == (100 * 1 + 2 + 100 * 4 + 8) / 202
    assert S.weighted_audio_loss(li.where("label = -1")).first().audio_loss == 0
    one = S.text_losses(li, [7]).first()
    assert one["mean"] == 3.75 and math.isnan(one.marked)
    flips = spark.createDataFrame([("x", 1.0, 2.0), ("x", 2.0, 1.0), ("x", float("nan"), 1.0), ("y", None, 1.0)], "s string, matched double, swapped double")
    assert {(r.style, r.n, r.effect, r.accuracy) for r in S.flip_summary(flips, "s").collect()} == {("x", 2, 0.0, 50.0), ("all", 2, 0.0, 50.0)}


def test_overlap_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), rng.choice("AB"), s, s + rng.choice([0, 3, 9, 40])) for s in [rng.randint(0, 300) for _ in range(120)]]
    want = {}
    for k in "xy":
        on = {c: {t for q, ch, s, e in rows if q == k and ch == c for t in range(s, e)} for c in "AB"}
        want[k] = len(on["A"] & on["B"])
    df = spark.createDataFrame([*rows, ("x", "A", None, 5), ("z", "A", 0, 9)], "k string, ch string, s long, e long")
    for block in (7, 100, 10_000):
        assert {r.k: r.both_ms for r in S.overlap_ms(df, "k", "ch", "s", "e", block).collect()} == want | {"z": 0}


def test_medians_and_places(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice([0.1, 0.2, 0.5, rng.random()])) for _ in range(201)]
    df = spark.createDataFrame(rows, "k string, v double")
    by = defaultdict(list)
    for k, v in rows:
        by[k].append(v)
    counts = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    assert {r.k: r["median"] for r in S.grouped_median(counts, ["k"], "v", "n").collect()} == {k: statistics.median(v) for k, v in by.items()}
    found = {r.name: r.value for r in S.order_statistics(df, "v", {"first": lambda n: n * 0, "mid": lambda n: F.floor(n / 2), "last": lambda n: n - 1}).collect()}
    values = sorted(v for _, v in rows)
    assert found == {"first": values[0], "mid": values[100], "last": values[-1]}


def test_best_label_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["p", "q", "r"]), sorted({rng.choice("abcdefghij") for _ in range(rng.randint(0, 5))})) for i in range(60)]
    sets = defaultdict(set)
    for _, label, items in rows:
        sets[label] |= set(items)
    want = {}
    for i, _, items in rows:
        scored = [(-len(set(items) & s) / (len(items) + len(s) - len(set(items) & s) + 1e-9), label) for label, s in sets.items() if set(items) & s]
        if scored:
            want[i] = min(scored)[1]
    df = spark.createDataFrame(rows, "i long, label string, items array<string>")
    assert {r.i: r.label for r in C.best_by_jaccard(df, "i", "label", "items").collect()} == want


def test_chat_and_text_blocks(spark):
    code = lambda t: F.transform(T.chars(t), lambda c: F.ascii(c))
    df = spark.createDataFrame([(["Hi!", None], "P\n---\nB", "body")], "t array<string>, prompted string, plain string")
    row = df.select(X.chat_ids(F.col("t"), code).alias("a"), X.chat_ids(F.col("t"), code, False).alias("b")).first()
    assert row.a == [1, 104, 105, 33, 2, 12290] and row.b == [2, 104, 105, 33, 1, 12290]
    ids, n = X.text_block(F.col("prompted"), code, 3)
    assert tuple(df.select(ids, n).first()) == ([1, 112, 2], 3)
    ids, n = X.text_block(F.col("plain"), code, None)
    assert tuple(df.select(ids, n).first()) == ([1, 98, 111, 100, 121], 0)


def test_text_kernels_agree_with_their_definitions(spark):
    texts = ["", None, "abc", "日本語です。 abc!", "１２ ab", " \u3000\t", "ー〜…🙂é", "a" * 500]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.non_japanese_ratio(F.col("t")).alias("r"), T.gram_set(F.col("t")).alias("g"), T.bigram_set(F.col("t")).alias("b")).collect()
    for r in rows:
        if r.t is None:
            assert r.r is None and r.g is None
            continue
        content = [c for c in r.t if not c.isspace() and (ord(c) > 127 or c.isalpha())]
        bad = [c for c in content if not ("\u3040" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff" or c in "、。！？「」（）・…ー〜")]
        assert r.r == (len(bad) / len(content) if content else 0.0)
        assert sorted(r.g) == sorted(r.b)


def test_byte_pieces_are_joined_to_characters():
    class Model:
        def encode(self, text, out_type=None):
            return ["▁", "a", "<0xF0>", "<0x9F>", "<0x99>", "<0x82>", "b", "<0xFF>", "c", "<0xE3>", "<0x81>"]

    model = SentencePiece("nowhere")
    model._model = Model()
    assert model.encode_pieces("x") == ["▁", "a", "🙂", "b", "\ufffd", "c", "\ufffd"]


def test_alternating_batches_of_a_short_base(spark):
    import pytest

    ids = lambda n: spark.range(n)
    with pytest.raises(ValueError, match="half a global batch"):
        S.alternating_batches(ids(7), ids(3), 2, 4, 4)
    assert S.alternating_batches(ids(7), ids(3), 2, 4, 4, drop_last=True).count() == 0
    plan = S.alternating_batches(ids(40), ids(3), 2, 4, 4).collect()
    steps = {}
    for r in plan:
        steps.setdefault((r.step, r.kind), []).append((r["rank"], r.slot))
    # Three base batches, the last filled from the base's own start; one of the other kind behind the second, filled by repeating.
    assert sorted(steps) == [(0, "base"), (1, "base"), (2, "alt"), (3, "base")]
    assert all(sorted(places) == [(k // 4, k % 4) for k in range(16)] for places in steps.values())
