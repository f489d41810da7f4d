"""Rules of annotation exports and graphs, and the query that lints whole exports."""

import hashlib
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from turnweave.operators import scores as S
from turnweave.plans import scoring

SEGMENT = "array<struct<channelId:string,startMs:bigint,endMs:bigint,transcript:string>>"


def test_annotation_problems(spark):
    a, b, blank = ("ch_1", 0, 10, "はい"), ("ch_2", 5, 20, "ＯＫ (笑)"), ("ch_1", 20, 30, "　 ")
    same = [("ch_2", 5, 20, "OK（笑）"), ("ch_1", 0, 10, " はい")]
    rows = [
        (1, [a, b], same, ["identical to prelabel"]), (2, [a, blank, ("ch_1", 40, 50, None)], None, ["2/3 empty transcripts"]),
        (3, [a], [a, b, b], ["segment count dropped 3->1"]), (4, [a, b], [a, b, a, b], []), (5, [], same, ["no segments"]), (6, None, same, ["no segments"]),
        (7, [a, ("x", 9, 9, "（泣）")], [b], ["seg[1] bad channelId", "seg[1] bad span", "seg[1] illegal tag （泣）"]),
        (8, [("ch_1", 0, 10, "Ok")], [("ch_1", 0, 10, "ok")], []),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], f"id int, segments {SEGMENT}, prelabel {SEGMENT}")
    found = {r.id: r.p for r in df.select("id", S.annotation_problems("segments", "prelabel").alias("p")).collect()}
    assert found == {r[0]: r[3] for r in rows}
    status = {r.id: r.s for r in df.select("id", S.annotation_status(S.annotation_problems("segments", "prelabel")).alias("s")).collect()}
    assert status == {1: "WARN", 2: "WARN", 3: "WARN", 4: "PASS", 5: "FAIL", 6: "FAIL", 7: "FAIL", 8: "PASS"}
    bare = df.where("id = 4").select(S.annotation_problems("segments", "prelabel", F.lit(False)).alias("p")).first().p
    assert bare == ["not a valid export"]


def test_graph_rules(spark):
    nodes = spark.createDataFrame([("a", None), ("concat", None), ("e", None), ("b", "a")], "id string, parent string")
    edges = spark.createDataFrame([("e", "a", "b"), ("toString", "a", "b"), ("f", "a", "b")], "id string, source string, target string")
    found = sorted((r.problem, r.id) for r in S.graph_problems(nodes, edges).collect())
    assert found == [("reserved name", "concat"), ("reserved name", "toString"), ("vertex and edge", "e")]
    edges = spark.createDataFrame([("x", None, "b", True), ("y", None, "b", False), ("z", "a", None, True)], "id string, source string, target string, source_point boolean")
    found = sorted((r.problem, r.id) for r in S.graph_problems(nodes.where("id <> 'concat'"), edges).collect())
    assert found == [("no source", "y"), ("no target", "z")]


def test_exports_hold_all_rows(spark, sf):
    found = scoring.met07_annotation_qa(spark, sf).collect()
    words = pd.read_parquet(f"{sf}/word_transcripts.parquet").sort_values("row_id")
    want = Counter()
    for dialogue, w in words.groupby("dialogue_id"):
        digest = hashlib.md5(dialogue.encode()).hexdigest()
        if digest.startswith("ff"):
            want[dialogue, "not a valid export"] += 1
            continue
        n, empty = len(w), sum(t is None or not t.strip() for t in w.word)
        for k, (s, e, speaker) in enumerate(zip(w.start, w.end, w.speaker)):
            want[dialogue, f"seg[{k}] bad channelId"] += speaker not in ("A", "B", "ch_1", "ch_2")
            want[dialogue, f"seg[{k}] bad span"] += not e > s
        want[dialogue, f"{empty}/{n} empty transcripts"] += empty > 0
        kind = ord(digest[0]) % 4
        voiced = any(t and t.strip() for t, c in zip(w.word, w.speaker) if c in ("A", "B", "ch_1", "ch_2"))
        channelled = w.speaker.isin(["A", "B", "ch_1", "ch_2"]).any()
        want[dialogue, "identical to prelabel"] += kind == 0 or (kind == 1 and not voiced) or (kind == 2 and not channelled)
        want[dialogue, f"segment count dropped {3 * n}->{n}"] += kind == 1
    got = Counter((r.dialogue_id, r.problem) for r in found if "illegal tag" not in r.problem)
    assert got == +want
