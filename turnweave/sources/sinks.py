"""Sinks: sharded Parquet, JSON lines, key lists, CSV, one document per chunk."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_shards(numbered: DataFrame, path: str, compression: str = "zstd") -> None:
    """Parquet with one folder per ``shard`` (see ``corpus.shards``); each shard is written by one task."""
    numbered.repartition("shard").write.option("compression", compression).partitionBy("shard").mode("overwrite").parquet(path)


def write_missing(rows: DataFrame, path: str, compression: str = "zstd") -> None:
    """Parquet that is written only where nothing stands yet and there are rows to write; a failed write leaves nothing behind."""
    if not rows.isEmpty():
        rows.write.option("compression", compression).mode("ignore").parquet(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_key_list(rows: DataFrame, key: str, path: str) -> None:
    """Keys in order, one a line (null keys are left out)."""
    rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string")).distinct().orderBy(key).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_chunks(chunks: DataFrame, path: str, name: str = "chunk_id") -> None:
    """JSON partitioned by the chunk's name."""
    chunks.write.mode("overwrite").partitionBy(name).json(path)


def write_files(rows: DataFrame, folder: str) -> int:
    """Each row (name, content) as a file below ``folder``; returns how many.

    A file is written under a name of its own and moved, so a task that fails or runs twice leaves no half
    of one. Works on any filesystem that Arrow knows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, root = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = f"{root}/{name}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                part = f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as file:
                    file.write(content)
                system.move(part, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    found = rows.select("name", "content").mapInArrow(run, "n bigint").agg(F.sum("n").alias("n")).first().n
    return found or 0


def write_arrays(rows: DataFrame, folder: str, name: str, matrix: str) -> int:
    """Each row's matrix as ``<name>.npy`` of 32-bit integers below ``folder``; null and ragged matrices are left out. Returns how many."""

    @F.arrow_udf("binary")
    def encoded(matrices: pa.Array) -> pa.Array:
        out = []
        for m in matrices.to_pylist():
            if m is None or any(r is None or len(r) != len(m[0]) for r in m):
                out.append(None)
                continue
            file = io.BytesIO()
            np.save(file, np.array(m, dtype=np.int32))
            out.append(file.getvalue())
        return pa.array(out, type=pa.binary())

    files = rows.select(F.concat(F.col(name), F.lit(".npy")).alias("name"), encoded(F.col(matrix)).alias("content")).where("content IS NOT NULL")
    return write_files(files, folder)
