"""The prompt's frames of all users: whole, and lying so that they take little room."""

from collections import defaultdict

from pyspark.sql import functions as F

from turnweave.plans import scoring


def test_prompt_frames_of_all_users_take_little_room(spark, tmp_path):
    n, users = 9_001, [*range(300), None]
    spark.createDataFrame([(1, n * 1_920 + 7), (2, None)], "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    events = [(k, u) for k, u in enumerate(users * 3)]
    spark.createDataFrame(events, "event_id long, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = scoring.stm04_phases(spark, str(tmp_path))
    found.write.parquet(f"{tmp_path}/found")
    found = spark.read.parquet(f"{tmp_path}/found")
    held = defaultdict(int)
    for k, u in events:
        held[u] += k * 37 % 3000 + 1
    each = found.groupBy("user_id", "phase").agg(*[F.expr(x) for x in ("count(*) n", "count(DISTINCT frame) frames", "min(k) lowest", "max(k) highest", "min(frame - k) least", "max(frame - k) most")])
    want = {(u, 0, n, n, 0, n - 1, 0, 0) for u in users} | {(u, 1, m // 1_920, m // 1_920, 0, m // 1_920 - 1, n, n) for u, m in held.items() if m >= 1_920}
    assert {tuple(r) for r in each.collect()} == want
    # A user's frames in order take 4 bytes a row and more.
    assert sum(p.stat().st_size for p in (tmp_path / "found").glob("*.parquet")) < 0.5 * found.count()


def test_no_whole_prompt_frame(spark, tmp_path):
    spark.createDataFrame([(1, 1_919)], "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 5) for k in range(2)], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert scoring.stm04_phases(spark, str(tmp_path)).collect() == []
