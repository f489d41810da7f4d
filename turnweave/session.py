"""Session helpers: a local session for tests and benches, checkpoint folder, Arrow group kernels."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", partitions: int = 8, name: str = "turnweave") -> SparkSession:
    """A local session with the settings this library is tested under (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("TURNWEAVE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset
    (tests on one machine) a temporary folder is used.
    """
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        _set_checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _set_checkpoint_folder(spark: SparkSession) -> None:
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="turnweave-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder for this application's own files, below the folder that all executors share."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        _set_checkpoint_folder(spark)
    return f"{context._jsc.sc().getCheckpointDir().get().rstrip('/')}/files-{uuid.uuid4().hex}"


def key_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Split a stream of batches, sorted by its first ``keys`` columns, into one table per key.

    Only the group under way is held; nulls in key columns form groups of their own.
    """
    held: list[pa.RecordBatch] = []

    def same(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
        return all(a.column(k)[a.num_rows - 1].as_py() == b.column(k)[0].as_py() for k in range(keys))

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        changed = None
        for k in range(keys if n > 1 else 0):
            column = batch.column(k)
            left, right = column.slice(0, n - 1), column.slice(1)
            differs = pc.fill_null(pc.not_equal(left, right), False)
            differs = pc.or_(differs, pc.xor(pc.is_null(left), pc.is_null(right)))
            changed = differs if changed is None else pc.or_(changed, differs)
        cuts = [] if changed is None else (pc.indices_nonzero(changed).to_numpy() + 1).tolist()
        starts, stops = [0, *cuts], [*cuts, n]
        for a, b in zip(starts, stops):
            piece = batch.slice(a, b - a)
            if held and not (a == 0 and same(held[-1], piece)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held)


def map_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    kernel: Callable[[pa.Table], Iterator[tuple]],
    schema: str,
    arrow_schema: pa.Schema,
    flush: int = 20_000,
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Hash-partition by ``keys``, sort by ``keys`` and ``order``, and run ``kernel`` over each group.

    Unlike a grouped pandas map, groups are cut from one Arrow stream per partition, so hundreds of
    thousands of small groups cost no per-group serialisation. ``kernel`` yields plain tuples.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def emit() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [() for _ in arrow_schema]
            arrays = [pa.array(c, type=f.type) for c, f in zip(columns, arrow_schema)]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow_schema)

        for table in key_groups(batches, len(keys)):
            rows.extend(kernel(table))
            if len(rows) >= flush:
                yield emit()
                rows.clear()
        if rows:
            yield emit()

    columns = [*keys, *[c for c in df.columns if c not in keys]]
    shuffled = df.select(*columns).repartition(*(partition_by or keys)).sortWithinPartitions(*keys, *order)
    return shuffled.mapInArrow(run, schema)
