"""Filling fixed-capacity containers with items (problem 3): bound-certified repacking.

Items are packed group by group with best-fit decreasing. Dual feasible functions give each group a
lower bound on the containers any packing of it needs; a group that meets its bound is certified and
final. From a group with a gap, full containers stay and the items of the others are exchanged: they
move into the union of neighbouring groups and are packed again, in a fixed number of rounds. The
last container of a group, mostly the only one with much room, is exchanged likewise, so that room is
shared by ever larger groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.session import map_groups

#: Items of a group at first, groups that join in a round, and rounds.
GROUP_ITEMS, JOIN, ROUNDS = 4_096, 16, 3


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container number of each item. Open containers stand in lists by room; a bit set finds the tightest."""
    by_room: dict[int, list[int]] = {}
    rooms, used = 0, 0
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[k]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = by_room[room]
            at = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            room, at, used = capacity, used, used + 1
        out[k] = at
        left = room - size
        if left:
            by_room.setdefault(left, []).append(at)
            rooms |= 1 << left
    return out


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that any packing needs at least: the best of two families of dual feasible functions.

    One counts items above ``capacity - t`` as full, those below ``t`` as nothing, the rest as they are;
    the other rounds to multiples of ``1/k``.
    """
    if not sizes:
        return 0
    counts: dict[int, int] = {}
    for s in sizes:
        counts[s] = counts.get(s, 0) + 1
    items = sorted(counts.items())
    best = -(-sum(s * n for s, n in items) // capacity)
    # All thresholds at once: prefix sums of counts and of sizes over the distinct sizes in order.
    sizes_at = np.array([s for s, _ in items], dtype=np.int64)
    count = np.concatenate(([0], np.cumsum([n for _, n in items])))
    volume = np.concatenate(([0], np.cumsum([s * n for s, n in items])))
    t = sizes_at[2 * sizes_at <= capacity]
    if len(t):
        first, full = np.searchsorted(sizes_at, t, "left"), np.searchsorted(sizes_at, capacity - t, "right")
        total = capacity * (count[-1] - count[full]) + volume[full] - volume[first]
        best = max(best, int((-(-total // capacity)).max()))
    for k in range(1, 21):
        total = 0  # in units of capacity / k / capacity
        for s, n in items:
            whole, rest = divmod(s * (k + 1), capacity)
            total += n * (s * k if not rest else whole * capacity)
        best = max(best, -(-total // (capacity * k)))
    return best


_ITEM = pa.schema([("grp", pa.int64()), ("dialogue_id", pa.string()), ("part", pa.int64()), ("frames", pa.int64()), ("container", pa.string()), ("certified", pa.bool_())])
_ITEM_DDL = "grp bigint, dialogue_id string, part bigint, frames bigint, container string, certified boolean"


def _round(number: int, capacity: int, last: bool):
    def kernel(table: pa.Table) -> Iterator[tuple]:
        grp = table.column(0)[0].as_py()
        rows = list(zip(*(c.to_pylist() for c in table.columns[1:])))
        for row in rows:
            if row[3] is not None:
                yield (grp, *row)
        rows = [r for r in rows if r[3] is None]
        if not rows:
            return
        rows.sort(key=lambda r: (r[0] is not None, r[0] or "", r[1]))
        sizes = [r[2] for r in rows]
        at = best_fit_decreasing(sizes, capacity)
        fill: dict[int, int] = {}
        for k, size in zip(at, sizes):
            fill[k] = fill.get(k, 0) + size
        certified = len(fill) == lower_bound(sizes, capacity)
        # A certified group exchanges only its emptiest container; one with a gap all that have room.
        emptiest = min(fill, key=lambda k: (fill[k], k))
        for (dialogue, part, size, _, _), k in zip(rows, at):
            stays = last or fill[k] == capacity or (certified and k != emptiest)
            yield grp, dialogue, part, size, f"r{number}-g{grp}-c{k}" if stays else None, certified

    return kernel


def pack(items: DataFrame, capacity: int, groups: int, rounds: int = ROUNDS) -> DataFrame:
    """Containers for items (dialogue_id, part, frames between 1 and ``capacity``).

    Adds ``container`` (unique) and ``certified``: the item's group met its lower bound.
    """
    key = F.pmod(F.xxhash64("dialogue_id", "part"), F.lit(max(1, groups)))
    out = items.select(key.alias("grp"), "dialogue_id", "part", "frames", F.lit(None).cast("string").alias("container"), F.lit(None).cast("boolean").alias("certified"))
    for number in range(rounds):
        if number:
            # Final rows are spread by their item, only the others gather in the joined group.
            moved = F.when(F.col("container").isNull(), F.floor(F.col("grp") / JOIN)).otherwise(-1 - F.pmod(F.xxhash64("dialogue_id", "part"), F.lit(max(8, groups))))
            out = out.withColumn("grp", moved)
        out = map_groups(out, ["grp"], [], _round(number, capacity, number == rounds - 1), _ITEM_DDL, _ITEM)
    return out.drop("grp")


def stream_length(streams: Column) -> Column:
    """Length of the longest of a side's streams; a null side, a null stream and an empty side count 0."""
    return F.coalesce(F.array_max(F.transform(streams, lambda s: F.coalesce(F.size(s), F.lit(0)))), F.lit(0))


def dialogue_lengths(tokens: DataFrame) -> DataFrame:
    """Length of each dialogue's latest export. Lengths are taken before the shuffle, streams never move.

    Of exports at the same time the one with the greatest row id counts; a null time is the earliest.
    """
    frames = F.greatest(stream_length(F.col("A")), stream_length(F.col("B")))
    order = F.struct(F.coalesce(F.col("exported_at"), F.lit("0001-01-01").cast("timestamp_ntz")).alias("t"), F.col("row_id"))
    rows = tokens.select("dialogue_id", frames.cast("bigint").alias("frames"), order.alias("o"))
    return rows.groupBy("dialogue_id").agg(F.max_by("frames", "o").alias("frames"))


def pack_dialogues(tokens: DataFrame, capacity: int = 1_024) -> DataFrame:
    """Containers of ``capacity`` frames for every dialogue: dialogue_id, part, n_parts, frames, container, certified.

    Only dialogues longer than the capacity are split: into full containers of their own and a rest
    that is packed with the others. Dialogues of length 0 need no container and give no row.
    """
    lengths = dialogue_lengths(tokens).where("frames > 0")
    n_parts = F.ceil(F.col("frames") / capacity)
    parts = lengths.withColumn("n_parts", n_parts).select(
        "dialogue_id", "n_parts", F.col("frames").alias("whole"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_parts"))).alias("part")
    )
    size = F.when(F.col("part") < F.col("n_parts"), F.lit(capacity)).otherwise(F.col("whole") - (F.col("n_parts") - 1) * capacity).cast("bigint")
    parts = parts.select("dialogue_id", "part", "n_parts", size.alias("frames"))
    full = parts.where(F.col("frames") == capacity).select(
        "dialogue_id", "part", "n_parts", "frames", F.format_string("full-%s-%d", F.coalesce("dialogue_id", F.lit("")), "part").alias("container"), F.lit(True).alias("certified")
    )
    open_items = parts.where(F.col("frames") < capacity)
    groups = -(-dialogue_count(tokens) // GROUP_ITEMS)
    packed = pack(open_items.select("dialogue_id", "part", "frames"), capacity, groups)
    packed = packed.select("dialogue_id", "part", F.col("part").alias("n_parts"), "frames", "container", "certified")
    return full.unionByName(packed)


def dialogue_count(tokens: DataFrame) -> int:
    """About how many dialogues there are: one sketch, read from the id column alone."""
    return int(tokens.agg(F.approx_count_distinct("dialogue_id").alias("n")).first().n)


def split_dialogues(packed: DataFrame) -> DataFrame:
    """Dialogues of which a later part was packed: those that had to be split."""
    return packed.where("part > 1").select("dialogue_id").distinct()


def fill(packed: DataFrame, capacity: int = 1_024) -> DataFrame:
    """One row over all containers: items, frames, containers, the fewest that could hold the frames, wasted frames and their share.

    Without containers all counts are 0 and the share is null.
    """
    used = packed.groupBy("container").agg(F.sum("frames").alias("frames"), F.count("*").alias("n"))
    total = used.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("frames"), F.lit(0)).alias("frames"), F.count("*").alias("n_containers"))
    room = F.col("n_containers") * capacity
    return total.select("n_items", "frames", "n_containers", F.ceil(F.col("frames") / capacity).alias("fewest"), (room - F.col("frames")).alias("wasted"), ((room - F.col("frames")) / F.nullif(room, F.lit(0))).alias("wasted_share"))
