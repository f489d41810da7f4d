from pyspark.sql import functions as F

from turnweave.plans import scoring
from turnweave.streaming import live
from turnweave.streaming.messages import decode_message


def test_rechunk_equals_its_batch_twin(spark, sf, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", (F.col("event_id") * 37 % 3000 + 1).alias("n"))
    rows.orderBy("event_id").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = live.rechunk(stream).writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    found = {tuple(r) for r in spark.sql("SELECT user_id, event_id, frame FROM frames").collect()}
    assert found and found == {tuple(r) for r in scoring.stm03_rechunk(spark, sf).collect()}


def test_jitter_equals_its_batch_twin(spark, sf, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = spark.read.parquet(f"{sf}/events.parquet").where("user_id < 6").select("user_id", "event_id", (F.col("value") % 40).alias("arrive_ms"), F.lit(20.0).alias("play_ms"))
    for k in range(3):
        e.where((F.col("event_id") >= k * 400) & (F.col("event_id") < (k + 1) * 400)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.jitter_stream(stream).writeStream.outputMode("update").format("memory").queryName("jitter").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    last = {}
    for r in spark.sql("SELECT * FROM jitter").collect():
        last[r.user_id] = max(last.get(r.user_id, (0,)), (r.n, *tuple(r)[1:7]))
    assert last and {k: v[1:] for k, v in last.items()} == {r.user_id: tuple(r)[1:7] for r in live.jitter(e).collect()}


def test_idle_sessions_on_a_stream(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "ts")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = live.idle_sessions(stream, "10 minutes").writeStream.outputMode("append").format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    streamed = {(r.user_id, r.first_id, r.n) for r in spark.sql("SELECT * FROM idle").collect()}
    batch = {(r.user_id, r.first_id, r.n) for r in live.idle_sessions(rows, "10 minutes").collect()}
    assert streamed and streamed <= batch and len(batch) - len(streamed) < 20  # the last sessions stay open


def test_messages(spark):
    rows = [(b"\x01ab",), (b"\x02hi",), (b"\x07\x05hi",), (b"\x00",), (b"",), (None,), (b"\x09x",), (b"\x04{}",)]
    frame = spark.createDataFrame(rows, "message binary")
    out = [(r.m.kind, r.m.text) for r in frame.select(decode_message(F.col("message")).alias("m")).collect()]
    assert out == [("audio", None), ("text", "hi"), ("coloured", "hi"), ("handshake", None), ("empty", None), (None, None), ("unknown", None), ("metadata", "{}")]
    assert [bytes(r.payload) for r in live.accepted(frame).collect()] == [b"ab"]
    assert sorted(r.reason for r in live.rejected(frame).collect()) == sorted(["text", "coloured", "handshake", "empty", "not binary", "unknown", "metadata"])


def test_jitter_and_cursor():
    b = live.JitterBuffer()
    b.arrive(40)
    assert b.play(20) == 0
    b.arrive(40)
    assert b.started and b.play(20) == 0 and b.play(20) == 20
    b.arrive(100)
    assert b.dropped == 60 and b.level == 100 and b.maximum == 35
    while b.started:
        b.play(30)
    assert b.underruns == 1 and b.partial == 25
    # Either padding stands as it came; any other emission takes the next text id.
    assert live.text_cursor([3, 9, 0, 9, 3], [51, 52, 53]) == [3, 51, 0, 52, 3]
    # Padding in the text is taken whatever was emitted, and what follows the text counts as padding.
    assert live.text_cursor([0, 0, 9, 0], [3, 51, 3]) == [3, 0, 51, 3] and live.text_cursor([9, 0, 9], [51]) == [51, 3, 3]
    # The run ends where the end id stands.
    assert live.text_cursor([3, 9, 9, 9], [51, -1, 52]) == [3, 51] and live.text_cursor([], [51]) == []


def test_held_audio(spark):
    row = spark.createDataFrame([([[1, 2, 3, 4], [5, 6, 7, 8]],)], "s array<array<int>>").select(live.held_audio(F.col("s"), [1, 3], 1, 99).alias("x")).first()
    assert row.x == [[1, 2, 3, 4], [99, 99, 7, 8]]


def test_accumulated_text_on_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ddl = "user_id long, event_id long, opens boolean, text string"
    rows = [(1, 1, True, None), (1, 2, False, "a"), (1, 3, False, "b"), (2, 4, False, "x"), (1, 5, True, None), (1, 6, False, "c"), (2, 7, False, "y")]
    for k in range(2):
        spark.createDataFrame(rows[k * 4 : k * 4 + 4], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = {(r.user_id, r.socket): (r.n, r.n_total, r.text) for r in live.accumulated(spark.createDataFrame(rows, ddl), "user_id", "event_id").collect()}
    assert batch == {(1, 1): (2, 2, "ab"), (1, 2): (1, 3, "c"), (2, 0): (2, 2, "xy")}
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.accumulate_stream(stream).writeStream.outputMode("update").format("memory").queryName("said").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    last = {}
    for r in spark.sql("SELECT * FROM said").collect():
        last[r.user_id] = max(last.get(r.user_id, (0,)), (r.n_total, r.socket, r.n, r.text))
    assert last == {1: (3, 2, 1, "c"), 2: (2, 0, 2, "xy")}


def test_jitter_reports_every_so_many_messages(spark):
    rows = spark.range(25).selectExpr("1L as user_id", "id as event_id", "20.0D as arrive_ms", "20.0D as play_ms")
    assert sorted(r.n for r in live.jitter(rows, 10).collect()) == [10, 20, 25] and [r.n for r in live.jitter(rows).collect()] == [25]
