"""Speech transcripts into clean speaker turns (problem 4).

A sweep line goes over each dialogue's usable rows by start and row id, in blocks of time. Words
delivered twice with equal times meet side by side there, and the first is kept. On request, captions
that roll on are cut back too: words that repeat, under new times, the suffix of what their channel has
just said are dropped (``words.rolled_on``), over block edges as well, as blocks overlap by a halo. What
is not speech is dropped, and the rest is split where the speaker changes and, on request, at pauses of
a length calibrated per language.

Blocks give partial turns; only the first and last of a block can go on in a neighbour, so only those
are stitched, level by level (blocks into spans of blocks, then spans). No task holds a whole dialogue.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.llm.confusables import Spelling
from turnweave.llm.forms import Forms, languages
from turnweave.llm.words import BLOCK_MS, KEYS, ORDER, blocked, delivered_once, rolled_on
from turnweave.session import checkpointed, map_groups

# Pairs of brackets that set an annotation off, and marks that do so on both sides.
BRACKETS = {"[": "]", "(": ")", "<": ">", "{": "}", "【": "】", "〔": "〕", "〈": "〉", "《": "》"}
MARKS = "*♪~#_|="

_SET_OFF = regex.compile("|".join([rf"{regex.escape(a)}+[^{regex.escape(a + b)}]*{regex.escape(b)}+" for a, b in BRACKETS.items()] + [rf"{regex.escape(m)}+[^{regex.escape(m)}]+{regex.escape(m)}+" for m in MARKS]))
_OPENS = regex.compile(rf"^[{regex.escape(''.join(BRACKETS) + MARKS)}]+[^{regex.escape(''.join(BRACKETS.values()) + MARKS)}]*$")
_CLOSES = regex.compile(rf"^[^{regex.escape(''.join(BRACKETS) + MARKS)}]*[{regex.escape(''.join(BRACKETS.values()) + MARKS)}]+$")
_OUTER = regex.compile(r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$")
_SOUND = regex.compile(r"[\p{L}\p{N}]")
_CLOCK = regex.compile(r"\d{1,3}(?::\d{2}){1,2}(?:[.,]\d+)?")


def filler_pattern(forms: list[str]) -> regex.Pattern | None:
    """Matches the base forms and what is drawn out from them: each run of a letter as long or longer, or a length mark behind."""
    parts = []
    for form in sorted({f.lower() for f in forms if f}):
        runs = [m[0] for m in regex.finditer(r"(.)\1*", form, regex.DOTALL)]
        parts.append("".join(f"{regex.escape(r[0])}{{{len(r)},}}" for r in runs) + "ー*")
    return regex.compile("|".join(f"(?:{p})" for p in parts)) if parts else None


def is_speech(form: str, filler: regex.Pattern | None) -> bool:
    """Whether a word in consistent form is speech.

    Not speech: nothing with a letter or digit, a sound annotation (set off by brackets or marks, or
    one half of one that runs over two rows), a clock or bracketed time, a hesitation of the language.
    A word with an annotation attached and a plain number are speech.
    """
    rest = _SET_OFF.sub("", form)
    if not _SOUND.search(rest):
        return False
    if rest != form:
        return True
    if _OPENS.match(form) or _CLOSES.match(form):
        return False
    bare = _OUTER.sub("", form)
    if _CLOCK.fullmatch(bare):
        return False
    return not (filler and filler.fullmatch(bare.lower()))


_PART = pa.schema(
    [("dialogue_id", pa.string()), ("block", pa.int64()), ("channel", pa.string()), ("first_row_id", pa.int64()), ("last_row_id", pa.int64())]
    + [("first_ms", pa.int64()), ("last_ms", pa.int64()), ("reach_ms", pa.int64()), ("n_words", pa.int64()), ("text", pa.string()), ("edge", pa.int32()), ("at", pa.int64()), ("pause_ms", pa.int64())]
)
_PART_DDL = "dialogue_id string, block bigint, channel string, first_row_id bigint, last_row_id bigint, first_ms bigint, last_ms bigint, reach_ms bigint, n_words bigint, text string, edge int, at bigint, pause_ms bigint"


def _partial_turns(fillers: dict[str, list[str]], pauses: dict | None, with_text: bool, rolling_ms: int | None, spelling: Spelling):
    patterns = {lang: filler_pattern(forms) for lang, forms in fillers.items()}
    state: dict = {}

    def kernel(table: pa.Table) -> Iterator[tuple]:
        forms = state.setdefault("forms", Forms(spelling))
        speech = state.setdefault("speech", {})
        if len(speech) > 200_000:
            speech.clear()
        dialogue, block = table.column(0)[0].as_py(), table.column(1)[0].as_py()
        turns: list[list] = []
        pause_ms = None
        rows = delivered_once(table, forms)
        if rolling_ms is not None:
            rows = list(rows)
            rows = [r for r, again in zip(rows, rolled_on(rows, rolling_ms)) if r[6] and not again]
        for start, end, row_id, channel, form, lang, _ in rows:
            if pauses is not None:
                pause_ms = pauses.get(lang, pauses.get(None))
            known = speech.get((form, lang))
            if known is None:
                known = speech[form, lang] = is_speech(form, patterns.get(lang))
            if not known:
                continue
            turn = turns[-1] if turns else None
            if turn and turn[0] == channel and (pause_ms is None or start - turn[5] <= pause_ms):
                turn[2], turn[4], turn[5], turn[6] = row_id, start, max(turn[5], end), turn[6] + 1
                if with_text:
                    turn[7].append(form)
            else:
                turns.append([channel, row_id, row_id, start, start, end, 1, [form] if with_text else []])
        leading = True  # parts of one channel at the front: a word of an earlier block may bridge their pauses
        for k, (channel, first, last, first_ms, last_ms, reach, n, text) in enumerate(turns):
            leading = leading and channel == turns[0][0]
            edge = leading + 2 * (k == len(turns) - 1)
            yield dialogue, block, channel, first, last, first_ms, last_ms, reach, n, " ".join(text) if with_text else None, edge, k, pause_ms

    return kernel


def _stitch(parts: DataFrame, span: int | None, paused: bool) -> DataFrame:
    """Join edge parts that go on in the next one, within spans of ``span`` blocks (None: the whole dialogue)."""
    edges = parts.where("edge > 0")
    where = [F.col("dialogue_id"), *([F.floor(F.col("block") / span)] if span else [])]
    w = Window.partitionBy(*where).orderBy("block", "at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    # Between edges of one block that do not follow each other lie inner parts of another channel.
    skips = F.coalesce((F.lag("block").over(w) == F.col("block")) & (F.lag("at").over(w) + 1 != F.col("at")), F.lit(False))
    changes = ~F.col("channel").eqNullSafe(F.lag("channel").over(w))
    edges = edges.withColumn("step", F.when(skips, 2).when(changes, 1).otherwise(0))
    if paused:
        # What a channel's earlier words reach can only matter up to the next pause, so the run's maximum serves.
        edges = edges.withColumn("same", F.sum("step").over(upto))
        before = Window.partitionBy(*where, "same").orderBy("block", "at").rowsBetween(Window.unboundedPreceding, -1)
        silent = F.coalesce(F.col("first_ms") - F.max("reach_ms").over(before) > F.col("pause_ms"), F.lit(False))
        edges = edges.withColumn("step", F.when(silent, 1).otherwise(F.col("step")))
    # Numbers of runs that follow each other differ by one, others by two.
    runs = edges.withColumn("run", F.sum("step").over(upto))
    key = F.floor(F.col("block") / span) if span else F.lit(0)
    joined = (
        runs.withColumn("node", key)
        .groupBy("dialogue_id", "node", "run")
        .agg(
            F.first("channel").alias("channel"),
            F.min_by("first_row_id", F.struct("block", "at")).alias("first_row_id"),
            F.max_by("last_row_id", F.struct("block", "at")).alias("last_row_id"),
            F.min("first_ms").alias("first_ms"),
            F.max("last_ms").alias("last_ms"),
            F.max("reach_ms").alias("reach_ms"),
            F.sum("n_words").alias("n_words"),
            F.first("pause_ms").alias("pause_ms"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "text"))), lambda x: x.text), " ").alias("text"),
        )
    )
    if not span:
        return joined.withColumn("edge", F.lit(0)).drop("node", "run")
    o = Window.partitionBy("dialogue_id", "node").orderBy("run")
    apart = ~F.col("channel").eqNullSafe(F.lag("channel").over(o)) | (F.lag("run").over(o) + 1 != F.col("run"))
    joined = joined.withColumn("apart", F.when(apart, 1).otherwise(0))
    joined = joined.withColumns({"changes": F.sum("apart").over(o.rowsBetween(Window.unboundedPreceding, 0)), "last": F.lead("run").over(o).isNull()})
    at_edge = F.when(F.col("changes") == 1, 1).otherwise(0) + F.when(F.col("last"), 2).otherwise(0)
    joined = joined.withColumn("edge", at_edge).drop("changes", "last", "apart")
    return joined.select("dialogue_id", F.col("node").alias("block"), *[c for c in joined.columns if c not in ("dialogue_id", "node", "run")], F.col("run").alias("at"))


_OUT = ["dialogue_id", "channel", "first_row_id", "last_row_id", "first_ms", "last_ms", "reach_ms", "n_words", "text"]


def speaker_turns(
    words: DataFrame,
    roles: DataFrame,
    dialogues: DataFrame,
    fillers: dict[str, list[str]],
    pauses: dict[str | None, int] | None = None,
    with_text: bool = True,
    rolling_ms: int | None = None,
    block_ms: int = BLOCK_MS,
    span: int = 256,
    spelling: Spelling | None = None,
) -> DataFrame:
    """Clean turns: dialogue, channel (A or B), first and last row id, times, word count and text.

    ``pauses`` also splits a turn where a channel is silent for longer than its language's pause (the
    entry None serves languages without one; without ``pauses`` turns end at speaker changes only).
    ``rolling_ms`` also drops what captions that roll on repeat within that time. Rows that are not
    usable give nothing; null words count as empty and are no speech; a dialogue without speech gives no
    turn. Ties in start go by row id. Extra columns are not read. ``spelling`` is the table of confusables.
    """
    rows = blocked(words, roles, dialogues, block_ms, rolling_ms or 0)
    # Read three times below; one row per turn, so writing it is far cheaper than a second sweep.
    kernel = _partial_turns(fillers, pauses, with_text, rolling_ms, spelling or Spelling())
    parts = checkpointed(map_groups(rows, KEYS, ORDER, kernel, _PART_DDL, _PART))
    level = _stitch(parts, span, pauses is not None)
    inner = parts.where("edge = 0").select(*_OUT)
    return inner.unionByName(level.where("edge = 0").select(*_OUT)).unionByName(_stitch(level, None, pauses is not None).select(*_OUT))


def filler_forms(fillers: DataFrame, most: int = 100_000) -> dict[str, list[str]]:
    """The fixed list of hesitation sounds by language. It is a vocabulary, not corpus data: more than ``most`` forms raise an error."""
    rows = fillers.select("lang", "form").where("form IS NOT NULL").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"fillers holds more than {most} forms; it is meant to be a fixed word list")
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r.lang, []).append(r.form)
    return out


def calibrated_pauses(words: DataFrame, roles: DataFrame, dialogues: DataFrame, fraction: float = 0.98) -> DataFrame:
    """Pause length per language (``lang``, ``pause_ms``): the quantile of silences between neighbouring words of a channel.

    Silences are sketched per dialogue where they arise; the sketches, not the words, meet the languages
    and are merged. One row per language, and one with a null language for all of them together.
    """
    from turnweave.functions.labels import usable

    timed = usable(words.select("row_id", "dialogue_id", "speaker", "start", "end"), roles).withColumn("block", F.floor(F.col("start_ms") / BLOCK_MS))
    # Numbers are sorted, not names; ties in start give no silence in whatever order they come.
    timed = timed.select("dialogue_id", F.xxhash64("dialogue_id", "block", "channel").alias("stream"), "start_ms", "end_ms")
    w = Window.partitionBy("stream").orderBy("start_ms")
    silence = F.col("start_ms") - F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    sketches = timed.select("dialogue_id", silence.alias("ms")).where("ms > 0").groupBy("dialogue_id").agg(F.kll_sketch_agg_bigint("ms", F.lit(800)).alias("sketch"))
    by_lang = sketches.join(languages(dialogues), "dialogue_id", "left").select(F.explode(F.array(F.col("_lang"), F.lit(None).cast("string"))).alias("lang"), "sketch")
    pause = F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(fraction)))
    return by_lang.groupBy("lang").agg(F.kll_merge_agg_bigint("sketch").alias("sketch")).select("lang", pause.alias("pause_ms"))
