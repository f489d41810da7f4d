"""Training examples from token matrices: delay, split or cut, labels, as one array kernel a batch.

Every cell of a 17-row matrix is touched several times on the way to an example. As nested array
expressions that is an interpreted step a cell (14 s for 2,000 dialogues); here rows are numpy slices of
the Arrow batch. There is no shuffle either way, and a row's columns ride along untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as t

from turnweave.config import TokenConfig

CFG = TokenConfig()
_MATRIX = t.ArrayType(t.ArrayType(t.IntegerType()))


class _Matrices:
    """The matrices of a list column, each as a view of the batch's own values. All rows of a matrix are of one length."""

    def __init__(self, column: pa.ListArray):
        self.outer = column.offsets.to_numpy()
        inner = column.values
        self.inner, self.values = inner.offsets.to_numpy(), inner.values.to_numpy(zero_copy_only=False)

    def __getitem__(self, k: int) -> np.ndarray:
        a, b = self.outer[k], self.outer[k + 1]
        if a == b:
            return np.zeros((0, 0), dtype=np.int32)
        return self.values[self.inner[a] : self.inner[b]].reshape(b - a, -1)


def delayed(matrix: np.ndarray, cfg: TokenConfig = CFG) -> np.ndarray:
    """Row i: initial id, initial ids for its delay, the row, pads up to the greatest delay."""
    n, frames = matrix.shape
    out = np.empty((n, frames + 1 + max(cfg.delays)), dtype=np.int32)
    for row, source, wait, initial, pad in zip(out, matrix, cfg.delays, cfg.initials, cfg.pads):
        row[: wait + 1] = initial
        row[wait + 1 : wait + 1 + frames] = source
        row[wait + 1 + frames :] = pad
    return out


def labelled(matrix: np.ndarray, cfg: TokenConfig = CFG, prompt_len: int | None = None) -> np.ndarray:
    """Ids below the row's initial id, the ignored label elsewhere and over a prompt of ``prompt_len`` frames, shifted by each row's delay."""
    out = np.where(matrix < np.array(cfg.initials, dtype=np.int32)[: len(matrix), None], matrix, np.int32(cfg.zero))
    if prompt_len is not None:
        for row, wait in zip(out, cfg.delays):
            row[: wait + 1 + prompt_len] = cfg.zero
    return out


def parts(matrix: np.ndarray, most: int) -> list[np.ndarray]:
    """Near-equal parts in time of at most ``most`` frames, the first ones longer by one; none of an empty matrix."""
    frames = matrix.shape[1]
    return np.array_split(matrix, -(-frames // most), axis=1) if frames else []


def _nested(matrices: list[np.ndarray]) -> pa.ListArray:
    sizes = np.array([m.shape[1] for m in matrices for _ in range(len(m))], dtype=np.int64)
    values = np.concatenate([m.ravel() for m in matrices]) if matrices else np.zeros(0, dtype=np.int32)
    rows = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), type=pa.int32()), pa.array(values, type=pa.int32()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(m) for m in matrices]))), type=pa.int32()), rows)


def made(rows: DataFrame, used: list[str], added: list[tuple[str, t.DataType]], make: Callable[..., Iterator[tuple]], flush_cells: int = 20_000_000) -> DataFrame:
    """Examples of each row: its other columns, the ``added`` ones, streams, labels, num_streams, num_frames.

    ``make`` takes the row's used columns (matrices as arrays, others as values) and yields tuples of the
    added columns' values, the streams and the labels.
    """
    kept = [c for c in rows.columns if c not in used]
    names = [n for n, _ in added]
    # Types of columns that go on are those of the input, whatever they are.
    fields = [rows.schema[c] for c in kept if c not in names] + [t.StructField(n, kind) for n, kind in added]
    fields += [t.StructField("streams", _MATRIX), t.StructField("labels", _MATRIX), t.StructField("num_streams", t.IntegerType()), t.StructField("num_frames", t.IntegerType())]
    kept = [c for c in kept if c not in names]
    arrow = {"int": pa.int32(), "bigint": pa.int64()}
    kinds = [arrow[k.simpleString()] for _, k in added]
    matrices = {c for c in used if isinstance(rows.schema[c].dataType, t.ArrayType) and isinstance(rows.schema[c].dataType.elementType, t.ArrayType)}

    def emit(batch: pa.RecordBatch, of: list[int], extra: list[tuple], streams: list, labels: list) -> pa.RecordBatch:
        columns = [batch.column(c).take(pa.array(of, type=pa.int64())) for c in kept]
        columns += [pa.array([e[k] for e in extra], type=kind) for k, kind in enumerate(kinds)]
        columns += [_nested(streams), _nested(labels), pa.array([len(m) for m in streams], type=pa.int32()), pa.array([m.shape[1] for m in streams], type=pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inputs = [_Matrices(batch.column(c)) if c in matrices else batch.column(c).to_pylist() for c in used]
            of, extra, streams, labels, cells = [], [], [], [], 0
            for k in range(batch.num_rows):
                for *values, m, label in make(*(x[k] for x in inputs)):
                    of.append(k)
                    extra.append(values)
                    streams.append(m)
                    labels.append(label)
                    cells += m.size
                if cells > flush_cells:
                    yield emit(batch, of, extra, streams, labels)
                    of, extra, streams, labels, cells = [], [], [], [], 0
            if of:
                yield emit(batch, of, extra, streams, labels)

    return rows.select(*kept, *used).mapInArrow(run, t.StructType(fields))
