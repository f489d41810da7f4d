"""Overlapping and gapped time intervals per entity: continuous periods and the gaps between them.

The aggregate's state is a list of sorted, disjoint intervals. Partial states are built before the
shuffle, one per batch, entity and time block; states of a block are combined by a linear merge;
blocks are then joined in a tree of fixed fan-in that carries one number upwards, the furthest end so
far. No level holds more than one block's list or one fan-in of summaries, so an entity with a third
of all rows is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.session import key_groups

#: Width of a leaf of the tree, and leaves per inner node.
BLOCK_MS = 600_000
FAN_IN = 64

_STATE = pa.schema([("entity", pa.string()), ("part", pa.string()), ("block", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
_STATE_DDL = "entity string, part string, block bigint, starts array<bigint>, ends array<bigint>"


def disjoint(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as sorted disjoint intervals; touching ones merge."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    opens = np.concatenate(([True], starts[1:] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(opens)[1:] - 1, [len(starts) - 1]))
    return starts[opens], reach[last]


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial states of each batch: entity and part as codes, one sort, one segmented running maximum."""
    for batch in batches:
        if not batch.num_rows:
            continue
        entity = batch.column(0).dictionary_encode()
        part = batch.column(1).dictionary_encode()
        codes = []
        for column in (entity, part):
            code = column.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            codes.append(code)
        block, start, end = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
        order = np.lexsort((start, block, codes[1], codes[0]))
        e, p, b, s, t = codes[0][order], codes[1][order], block[order], start[order], end[order]
        fresh = np.concatenate(([True], (e[1:] != e[:-1]) | (p[1:] != p[:-1]) | (b[1:] != b[:-1])))
        group = np.cumsum(fresh) - 1
        low = t.min()
        wide = int(t.max() - low) + 1
        if wide * int(group[-1] + 1) < 2**62:
            reach = np.maximum.accumulate(group * wide + (t - low)) - group * wide + low
        else:  # times too far apart for one running maximum over all groups
            reach = np.concatenate([np.maximum.accumulate(t[group == g]) for g in range(group[-1] + 1)])
        opens = fresh | np.concatenate(([True], s[1:] > reach[:-1]))
        first = np.flatnonzero(opens)
        last = np.concatenate((first[1:] - 1, [len(s) - 1]))
        heads = np.flatnonzero(fresh[first])
        offsets = np.concatenate((heads, [len(first)])).astype(np.int32)
        at = first[heads]
        names = [pa.array(np.where(c[at] < 0, 0, c[at]), mask=c[at] < 0) for c in (e, p)]
        yield pa.RecordBatch.from_arrays(
            [
                entity.dictionary.take(names[0]).cast(pa.string()),
                part.dictionary.take(names[1]).cast(pa.string()),
                pa.array(b[at]),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(s[first])),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(reach[last])),
            ],
            schema=_STATE,
        )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Combine the partial states of each (entity, part, block); a state that is alone passes unchanged."""
    for table in key_groups(batches, 3):
        if table.num_rows == 1:
            yield from table.cast(_STATE).to_batches()
            continue
        starts, ends = (table.column(k).combine_chunks().flatten().to_numpy() for k in (3, 4))
        starts, ends = disjoint(starts, ends)
        yield pa.RecordBatch.from_arrays(
            [
                *(table.column(k).slice(0, 1).combine_chunks().cast(_STATE.field(k).type) for k in range(3)),
                pa.array([starts], type=_STATE.field(3).type),
                pa.array([ends], type=_STATE.field(4).type),
            ],
            schema=_STATE,
        )


def _coalesced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Many one-row batches into few."""
    held, n = [], 0
    for batch in _merge(batches):
        held.append(batch)
        n += batch.num_rows
        if n >= 5_000:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def interval_states(rows: DataFrame, entity: Column, part: Column, start: Column, end: Column, block_ms: int = BLOCK_MS) -> DataFrame:
    """One state per entity, part and block, with ``carry``: the furthest end in all earlier blocks.

    Rows whose start or end is null, or whose end is not after the start, are no intervals and are
    left out. Null entities and parts form groups of their own. An empty input gives no rows. Only the
    four given expressions are read, so extra columns of any name do no harm.
    """
    plain = rows.select(
        entity.cast("string").alias("entity"),
        part.cast("string").alias("part"),
        F.floor(start / block_ms).cast("bigint").alias("block"),
        start.cast("bigint").alias("s"),
        end.cast("bigint").alias("e"),
    ).where("s IS NOT NULL AND e > s")
    keys = ["entity", "part", "node", "block"]
    partial = plain.mapInArrow(_partial, _STATE_DDL)
    leaves = (
        partial.withColumn("node", F.floor(F.col("block") / FAN_IN))
        .repartition("entity", "part", "node")
        .sortWithinPartitions("entity", "part", "block")
        .drop("node")
        .mapInArrow(_coalesced, _STATE_DDL)
        .withColumns({"node": F.floor(F.col("block") / FAN_IN), "last_end": F.element_at("ends", -1)})
    )
    within = Window.partitionBy(*keys[:3]).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    leaves = leaves.withColumn("inner_carry", F.max("last_end").over(within))
    top = Window.partitionBy("entity", "part").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    nodes = (
        leaves.groupBy(*keys[:3])
        .agg(F.max("last_end").alias("node_end"))
        .withColumn("outer_carry", F.max("node_end").over(top))
        .where("outer_carry IS NOT NULL")
        .select(*[F.col(k).alias(f"_{k}") for k in keys[:3]], "outer_carry")
    )
    on = F.col("entity").eqNullSafe(F.col("_entity")) & F.col("part").eqNullSafe(F.col("_part")) & (F.col("node") == F.col("_node"))
    return leaves.join(nodes, on, "left").select(
        "entity", "part", "block", "starts", "ends", F.greatest("inner_carry", "outer_carry").alias("carry")
    )


def _breaks(states: DataFrame) -> DataFrame:
    """States with ``breaks``: (gap start, gap end) before each interval that starts beyond all earlier ends."""
    earlier = F.transform(
        F.col("starts"),
        lambda _s, i: F.struct(
            F.greatest(F.col("carry"), F.when(i > 0, F.get("ends", i - 1))).alias("gap_start"),
            F.get("starts", i).alias("gap_end"),
        ),
    )
    return states.withColumn("breaks", F.filter(earlier, lambda g: F.col("carry").isNull() & g.gap_start.isNull() | (g.gap_end > g.gap_start)))


def gaps(states: DataFrame, least_ms: int = 1, most_ms: int | None = None) -> DataFrame:
    """The uncovered stretches (entity, part, gap_start, gap_end) whose length lies within both bounds."""
    out = _breaks(states).select("entity", "part", F.inline("breaks")).where("gap_start IS NOT NULL")
    length = F.col("gap_end") - F.col("gap_start")
    out = out.where(length >= least_ms)
    return out if most_ms is None else out.where(length <= most_ms)


def periods(states: DataFrame) -> DataFrame:
    """The continuous periods (entity, part, period_start, period_end).

    A period that runs over several blocks ends where the next break of any later block begins, or at
    the entity's last end; both come from a window over block summaries, not over intervals.
    """
    broken = _breaks(states).withColumns(
        {
            "next_here": F.get(F.col("breaks"), F.lit(0)).getField("gap_start"),
            "reach": F.greatest("carry", F.element_at("ends", -1)),
        }
    )
    after = Window.partitionBy("entity", "part").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    linked = broken.withColumns(
        {"next_later": F.last("next_here", ignorenulls=True).over(after), "end_later": F.max("reach").over(after)}
    )
    closing = F.coalesce("next_later", F.greatest("reach", "end_later"))
    rows = F.transform(
        F.col("breaks"),
        lambda g, i: F.struct(
            g.gap_end.alias("period_start"),
            F.coalesce(F.get(F.col("breaks"), i + 1).getField("gap_start"), closing).alias("period_end"),
        ),
    )
    return linked.select("entity", "part", F.inline(rows))
