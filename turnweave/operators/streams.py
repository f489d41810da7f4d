"""Token-stream operators on DataFrames: views, preprocessing pipelines, packing, prompts, overlays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from turnweave.config import TokenConfig
from turnweave.functions import arrays as X
from turnweave.operators import examples as E

CFG = TokenConfig()


def rectangular_sides(tokens: DataFrame, cfg: TokenConfig = CFG) -> DataFrame:
    """Rows whose two sides have text and all codebooks, both cut or padded to the shorter side's audio.

    Rows with a null or misshapen side are left out (``misshapen`` lists them). No shuffle.
    """
    rows = 1 + cfg.codebooks
    shaped = tokens.where((F.size("A") == rows) & (F.size("B") == rows))
    frames = F.least(F.size(F.get("A", F.lit(1))), F.size(F.get("B", F.lit(1))))
    fitted = lambda side: F.transform(side, lambda r, i: X.fit(r, F.col("_t"), F.when(i == 0, cfg.text_pad).otherwise(cfg.audio_initial)))
    return shaped.withColumn("_t", frames).where("_t > 0").withColumns({"A": fitted(F.col("A")), "B": fitted(F.col("B"))}).drop("_t")


def misshapen(tokens: DataFrame, cfg: TokenConfig = CFG) -> DataFrame:
    """Rows that ``rectangular_sides`` leaves out, with the reason (first that holds)."""
    rows = 1 + cfg.codebooks
    reason = (
        F.when(F.col("A").isNull() | F.col("B").isNull(), "null side")
        .when((F.size("A") == 0) | (F.size("B") == 0), "empty side")
        .when((F.size("A") != rows) | (F.size("B") != rows), "wrong number of streams")
        .when((F.coalesce(F.size(F.get("A", F.lit(1))), F.lit(0)) == 0) | (F.coalesce(F.size(F.get("B", F.lit(1))), F.lit(0)) == 0), "no audio")
    )
    return tokens.withColumn("reason", reason).where("reason IS NOT NULL")


def main_speaker_streams(sides: DataFrame) -> DataFrame:
    """Each dialogue twice: A as main speaker (rank 0), then B (rank 1); the matrix has 17 rows."""
    views = F.array(
        F.struct(F.lit(0).alias("speaker_rank"), X.main_view(F.col("A"), F.col("B")).alias("streams")),
        F.struct(F.lit(1).alias("speaker_rank"), X.main_view(F.col("B"), F.col("A")).alias("streams")),
    )
    return sides.select(*[c for c in sides.columns if c not in ("A", "B")], F.inline(views))


def preprocess_dialogue(sides: DataFrame, most: int, least: int, cfg: TokenConfig = CFG) -> DataFrame:
    """Main view, delay, split, minimum length, labels. The delay comes first, so only a dialogue's first part begins with initial columns."""

    def examples(a, b):
        for rank, (main, other) in enumerate(((a, b), (b, a))):
            for k, m in enumerate(E.parts(E.delayed(np.concatenate((main, other[1:])), cfg), most)):
                if m.shape[1] >= least:
                    yield rank, k, m, E.labelled(m, cfg)

    return E.made(sides, ["A", "B"], [("speaker_rank", IntegerType()), ("part", IntegerType())], examples)


def _examples(parts: DataFrame, least: int, cfg: TokenConfig) -> DataFrame:
    kept = parts.where(X.length_of(F.col("streams")) >= least)
    return kept.withColumns({"labels": X.labels(F.col("streams"), cfg), "num_streams": F.size("streams"), "num_frames": X.length_of(F.col("streams"))})


def preprocess_mono(sides: DataFrame, side: str, most_delay: int, most: int, least: int, key: str = "row_id", seed: int = 0, cfg: TokenConfig = CFG) -> DataFrame:
    """One speaker's matrix: one hashed delay for all its audio rows, delayed, split, labelled."""
    d = hashed_delay(F.col(key), most_delay, seed)
    rows = 1 + cfg.codebooks
    by_row = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.when(i == 0, 0).otherwise(d))
    padded = F.transform(F.col(side), lambda r: r)
    most_row = F.lit(most_delay)
    delayed = F.transform(
        padded,
        lambda r, i: F.concat(X.repeat(F.when(i == 0, cfg.text_initial).otherwise(cfg.audio_initial), F.get(by_row, i) + 1), r, X.repeat(F.when(i == 0, cfg.text_pad).otherwise(cfg.audio_initial), most_row - F.get(by_row, i))),
    )
    parts = sides.select(key, F.posexplode(X.split(delayed, most)).alias("part", "streams"))
    return _examples(parts, least, cfg)


def hashed_delay(key: Column, most: int, seed: int = 0) -> Column:
    """A delay of 0..most drawn from a hash of the key, alike in any engine."""
    word = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8)
    return (F.conv(word, 16, 10).cast("bigint") % (most + 1)).cast("int")


def pack(sides: DataFrame, group: Column, order: str, side: str, most: int) -> DataFrame:
    """Matrices of a group joined in time in ``order``, then split near-equally.

    A group is explicit: batches of a fixed number of dialogues, so its size is bounded by the caller.
    """
    gathered = sides.select(group.alias("pack_group"), F.struct(F.col(order), F.col(side).alias("m")).alias("x")).groupBy("pack_group").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    rows = F.transform(F.sequence(F.lit(0), F.size(F.get("xs", F.lit(0)).m) - 1), lambda i: F.flatten(F.transform("xs", lambda x: F.get(x.m, i))))
    return gathered.select("pack_group", F.posexplode(X.split(rows, most)).alias("part", "streams"))


def pack_groups(rows: DataFrame, order: str, per_group: int) -> DataFrame:
    """Number rows by ``order`` and add ``pack_group``: ``per_group`` neighbours each.

    The order is global, but no task numbers all rows: rows are ranged, counted per range, and the
    ranges' offsets (one number each) are added up.
    """
    return number_rows(rows, [F.col(order)], "_n").withColumn("pack_group", F.floor(F.col("_n") / per_group)).drop("_n")


def number_rows(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """A global row number from 0 in ``order`` without one task for all rows.

    Rows are range-partitioned once; the number is the partition's offset (a sum over one count per
    partition) plus the place inside it. Ties in ``order`` go by the rest of the row's hash.
    """
    from turnweave.session import checkpointed

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpointed(ranged.withColumn("_mono", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_mono", 33)))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_c"))
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    number = F.col("_offset") + F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(offsets, "_part").withColumn(out, number).drop("_mono", "_part", "_offset")


def prompted(sides: DataFrame, role: Column, voice: Column | None, delimiter: int | None, most: int | None, least: int, cfg: TokenConfig = CFG) -> DataFrame:
    """Prompt before the dialogue with A as main speaker, the tail cut at ``most``, delayed, labelled, prompt labels ignored."""
    # The length test comes first and from sizes alone, so nothing is built for rows that it drops.
    whole = X.prompt_length(role, voice, delimiter) + X.length_of(F.col("A"))
    whole = whole if most is None else F.least(whole, F.lit(most))
    rows = sides.where(whole + 1 + max(cfg.delays) >= least)
    rows = rows.withColumns({"prompt_len": X.prompt_length(role, voice, delimiter), "_prefix": X.prompt_prefix(role, voice, delimiter, 1 + 2 * cfg.codebooks, cfg)})

    def example(a, b, prefix, prompt_len):
        joined = np.concatenate((prefix, np.concatenate((a, b[1:]))), axis=1)
        m = E.delayed(joined if most is None else joined[:, :most], cfg)
        yield prompt_len, m, E.labelled(m, cfg, prompt_len)

    return E.made(rows, ["A", "B", "_prefix", "prompt_len"], [("prompt_len", IntegerType())], example)


def overlay_turns(turns: DataFrame, frames: DataFrame, key: str, cfg: TokenConfig = CFG) -> DataFrame:
    """Text rows of turns laid over frames: later turns overwrite cells that they fill.

    ``turns``: key, speaker, turn (order), first and last frame bounds (f0, f1), ids; ``frames``: key,
    n_frames. Ids are spread evenly over a turn's frames; with fewer frames than ids one id stands on
    each frame and the rest is dropped. Gives (key, speaker, text, dropped); pads are not ids.
    """
    span = F.greatest(F.lit(1), F.col("f1") - F.col("f0"))
    n = F.size("ids")
    placed = F.when(span >= n, X.linspace_positions(n, span)).otherwise(F.sequence(F.lit(0), F.greatest(span - 1, F.lit(0))))
    rows = turns.where(F.size("ids") > 0).withColumn("at", placed)
    cells = rows.select(key, "speaker", "turn", F.col("f0"), F.posexplode("at").alias("k", "p"), "ids")
    cells = cells.select(key, "speaker", "turn", (F.col("f0") + F.col("p")).alias("frame"), F.get("ids", F.col("k")).alias("id")).where(F.col("id") != cfg.text_pad)
    last = cells.groupBy(key, "speaker", "frame").agg(F.max_by("id", "turn").alias("id"))
    rows_of = last.groupBy(key, "speaker").agg(F.map_from_entries(F.collect_list(F.struct("frame", "id"))).alias("cells"))
    dropped = rows.groupBy(key, "speaker").agg(F.sum(F.greatest(n - span, F.lit(0))).alias("dropped"))
    text = F.transform(F.sequence(F.lit(0), F.col("n_frames") - 1), lambda f: F.coalesce(F.try_element_at("cells", f), F.lit(cfg.text_pad)))
    return rows_of.join(dropped, [key, "speaker"]).join(frames, key).where("n_frames > 0").select(key, "speaker", text.alias("text"), "dropped")


def undelayed_continuation(streams: Column, prompt_frames: int, continuation: Column, cfg: TokenConfig = CFG) -> Column:
    """The first frames of an undelayed context (without its initial column), followed by a continuation, delayed again."""
    context = X.cut_time(X.undelay(streams, cfg.delays), 1, prompt_frames)
    return X.delay(X.join_time(context, continuation), cfg)
