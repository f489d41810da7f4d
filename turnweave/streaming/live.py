"""Live operators on Structured Streaming, each over the same state machine as its batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnweave.streaming.messages import decode_message

FRAME = 1_920


def accepted(messages: DataFrame, column: str = "message") -> DataFrame:
    """Audio messages with their payload; works on streams and batches alike."""
    rows = messages.withColumn("_m", decode_message(F.col(column)))
    return rows.where("_m.kind = 'audio'").withColumn("payload", F.col("_m.payload")).drop("_m", column)


def rejected(messages: DataFrame, column: str = "message") -> DataFrame:
    """What ``accepted`` leaves out, with the reason."""
    kind = decode_message(F.col(column)).getField("kind")
    return messages.withColumn("reason", F.coalesce(kind, F.lit("not binary"))).where("reason <> 'audio'").drop(column)


class Rechunk(StatefulProcessor):
    """Arrivals of any size to frames of a fixed size; the state is the remainder and the frames so far."""

    def __init__(self, frame: int = FRAME):
        self.frame = frame

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "samples long, frames long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, frames = self.rest.get() if self.rest.exists() else (0, 0)
        out = []
        arrivals = pd.concat(list(rows)).sort_values("event_id")
        for event_id, n in zip(arrivals["event_id"], arrivals["n"]):
            held += int(n)
            while held >= self.frame:
                held -= self.frame
                out.append((key[0], int(event_id), frames))
                frames += 1
        self.rest.update((held, frames))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "frame"])

    def close(self) -> None:
        pass


def rechunk(stream: DataFrame, frame: int = FRAME) -> DataFrame:
    """Frames (user_id, event_id, frame) of a stream (user_id, event_id, n): the message that completes each frame.

    Needs the RocksDB state store. Arrivals of a micro-batch go in order of event_id.
    """
    return stream.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=Rechunk(frame), outputStructType="user_id long, event_id long, frame long", outputMode="Append", timeMode="None"
    )


class JitterBuffer:
    """Playback buffer that fills up before it plays, grows on trouble and never beyond its bounds (times in ms).

    It starts once ``initial`` is held, and then lets ``partial`` pass before the first sound. At
    maximum + partial + initial the oldest goes, down to initial + partial, and the maximum grows. An
    underrun grows the partial level and the buffer fills up again. At most ``step`` a time, ``bound`` in all.
    """

    def __init__(self, initial: float = 80.0, partial: float = 20.0, maximum: float = 30.0, step: float = 5.0, bound: float = 80.0):
        self.initial, self.partial, self.maximum, self.step, self.bound = initial, partial, maximum, step, bound
        self.level, self.wait, self.started, self.dropped, self.underruns = 0.0, 0.0, False, 0.0, 0

    def arrive(self, ms: float) -> None:
        self.level += ms
        if not self.started and self.level >= self.initial:
            self.started, self.wait = True, self.partial
        if self.level >= self.maximum + self.partial + self.initial:
            kept = self.initial + self.partial
            self.dropped += self.level - kept
            self.level = kept
            self.maximum = min(self.bound, self.maximum + self.step)

    def play(self, ms: float) -> float:
        """Take up to ``ms``; returns what was played."""
        if not self.started or self.level <= 0 or self.wait > 0:
            self.wait -= ms
            return 0.0
        taken = min(ms, self.level)
        self.level -= taken
        if taken < ms:
            self.underruns += 1
            self.partial = min(self.bound, self.partial + self.step)
            self.started = False
        return taken

    def state(self) -> tuple[float, float, float, float, int, bool]:
        return self.level, self.partial, self.maximum, self.dropped, self.underruns, self.started


class Jitter(StatefulProcessor):
    """The buffer of each key on a stream; its state goes from micro-batch to micro-batch and is reported after ``every`` messages, too."""

    def __init__(self, every: int = 0):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("buffer", "level double, partial double, maximum double, dropped double, underruns long, started boolean, wait double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        buffer, n, out = JitterBuffer(), 0, []
        if self.kept.exists():
            buffer.level, buffer.partial, buffer.maximum, buffer.dropped, buffer.underruns, buffer.started, buffer.wait, n = self.kept.get()
        arrivals = pd.concat(list(rows)).sort_values("event_id")
        for a, p in zip(arrivals["arrive_ms"], arrivals["play_ms"]):
            buffer.play(float(p))
            buffer.arrive(float(a))
            n += 1
            if self.every and n % self.every == 0:
                out.append((key[0], *buffer.state(), n))
        self.kept.update((*buffer.state(), buffer.wait, n))
        if not out or out[-1][-1] != n:
            out.append((key[0], *buffer.state(), n))
        yield pd.DataFrame(out, columns=["user_id", "level", "partial", "maximum", "dropped", "underruns", "playing", "n"])

    def close(self) -> None:
        pass


def jitter_stream(stream: DataFrame, every: int = 0) -> DataFrame:
    """The buffer's state of each key after each micro-batch, with the messages seen so far. Needs the RocksDB state store."""
    ddl = "user_id long, level double, partial double, maximum double, dropped double, underruns long, playing boolean, n long"
    return stream.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Jitter(every), outputStructType=ddl, outputMode="Update", timeMode="None")


def jitter(arrivals: DataFrame, every: int = 0) -> DataFrame:
    """Batch twin: the buffer of each key (user_id) at its end, fed with (event_id, arrive_ms, play_ms) in order.

    ``every`` also reports it after each so many messages; ``n`` counts those seen.
    """
    import pyarrow as pa

    from turnweave.session import map_groups

    def kernel(table: pa.Table) -> Iterator[tuple]:
        buffer, n = JitterBuffer(), table.num_rows
        for k, (a, p) in enumerate(zip(table.column(1).to_pylist(), table.column(2).to_pylist()), 1):
            buffer.play(p)
            buffer.arrive(a)
            if k == n or every and k % every == 0:
                yield (table.column(0)[0].as_py(), *buffer.state(), k)

    names = ["level", "partial", "maximum", "dropped", "underruns", "playing", "n"]
    kinds = [pa.float64()] * 4 + [pa.int64(), pa.bool_(), pa.int64()]
    schema = pa.schema([("user_id", pa.int64()), *zip(names, kinds)])
    ddl = "user_id long, level double, partial double, maximum double, dropped double, underruns long, playing boolean, n long"
    return map_groups(arrivals.select("user_id", "arrive_ms", "play_ms", "event_id"), ["user_id"], ["event_id"], kernel, ddl, schema)


def idle_sessions(stream: DataFrame, gap: str = "10 seconds", late: str = "0 seconds") -> DataFrame:
    """Sessions of a key that end after a gap without messages; on a stream they come out behind the watermark."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if stream.isStreaming else rows
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def accumulated(messages: DataFrame, key: str, order: str) -> DataFrame:
    """Each socket's text: messages (key, order, opens, text) in order; one that ``opens`` a new socket empties the text, not the count.

    (key, socket, n, n_total, text): texts of the socket and of all sockets up to its end. Messages
    without text only open sockets; those before the first opening belong to socket 0.
    """
    w = Window.partitionBy(key).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = messages.withColumn("socket", F.sum(F.col("opens").cast("long")).over(upto)).where("text IS NOT NULL")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "text"))), lambda x: x.text), "")
    per = rows.groupBy(key, "socket").agg(F.count("*").alias("n"), texts.alias("text"))
    total = F.sum("n").over(Window.partitionBy(key).orderBy("socket").rowsBetween(Window.unboundedPreceding, 0))
    return per.withColumn("n_total", total)


class Accumulate(StatefulProcessor):
    """The text of each key's open socket on a stream, with the count of all its messages."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("text", "socket long, text string, n long, n_total long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        socket, text, n, n_total = self.kept.get() if self.kept.exists() else (0, "", 0, 0)
        arrivals = pd.concat(list(rows)).sort_values("event_id")
        for opens, said in zip(arrivals["opens"], arrivals["text"]):
            if opens:
                socket, text, n = socket + 1, "", 0
            if said is not None:
                text, n, n_total = text + said, n + 1, n_total + 1
        self.kept.update((socket, text, n, n_total))
        yield pd.DataFrame([(key[0], socket, n, n_total, text)], columns=["user_id", "socket", "n", "n_total", "text"])

    def close(self) -> None:
        pass


def accumulate_stream(stream: DataFrame) -> DataFrame:
    """``accumulated`` on a stream (user_id, event_id, opens, text): the open socket of each key after each micro-batch. Needs the RocksDB state store."""
    ddl = "user_id long, socket long, n long, n_total long, text string"
    return stream.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Accumulate(), outputStructType=ddl, outputMode="Update", timeMode="None")


def text_cursor(emissions: list[int], texts: list[int], pad: int = 3, epad: int = 0, end: int = -1) -> list[int]:
    """The text row of a run: what stands at each step, given what the model emitted there and the text it has to say.

    The next text id is taken, and stands, where the emission is neither of the two paddings, or where
    that next id is itself padding; elsewhere the emitted padding stands. Behind the last text id the
    next one counts as padding. The run is as long as the steps before the first ``end`` that stands.
    """
    out, at = [], 0
    for e in emissions:
        following = texts[at] if at < len(texts) else pad
        taken = following == pad or e not in (pad, epad)
        stands = following if taken else e
        if stands == end:
            break
        at += taken
        out.append(stands)
    return out


def held_audio(streams: Column, delays: list[int], given: int, initial: int) -> Column:
    """Audio rows of a run: cells hold the initial id until their row's delay has passed; ``given`` frames of it lie in the prompt."""
    waits = F.array(*[F.lit(max(0, d - given)) for d in delays])
    return F.transform(streams, lambda row, k: F.transform(row, lambda x, t: F.when(t < F.get(waits, k), initial).otherwise(x)))
