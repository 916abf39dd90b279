"""Vector tables as blocks of rows (shared by operators 8 and 10).

Definitions: rows with a null id, a null vector, or a vector with a null, NaN or
infinite element take no part; of rows with the same id the greatest array
counts, so repeated rows are one; shorter vectors end in zeros; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaloom.llm.durable import durable

#: Most rows of a block.
BLOCK_ROWS = 4096
_BLOCK = T.StructType([T.StructField("block", T.LongType()), T.StructField("rows", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("data", T.BinaryType())])


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, v)``, one row an id."""
    v = F.col(vector).cast("array<float>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(fine).groupBy(F.col(key).cast("long").alias("id")).agg(F.max(v).alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as float32, padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    offs = column.offsets.to_numpy().astype(np.int64)
    size = np.diff(offs)
    if (size == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim), np.float32)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(offs[:-1] - offs[0], size)] = flat
    return out


def rotation(vectors: DataFrame, dim: int, centred: bool) -> np.ndarray:
    """Orthonormal axes, those of the largest second moment first.

    The moments of each partition are summed on the executors; only a few
    dim x dim matrices reach the driver.
    """
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("s", T.BinaryType()), T.StructField("m", T.BinaryType())])

    def pack(n: int, s: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=schema.names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, m = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            x = matrix(batch.column(0), dim).astype(np.float64)
            n, s, m = n + len(x), s + x.sum(axis=0), m + x.T @ x
        if n:
            yield pack(n, s, m)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, m = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            for k, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                n, s, m = n + k, s + np.frombuffer(a), m + np.frombuffer(b).reshape(dim, dim)
        if n:
            yield pack(n, s, m)

    n, s, m = 0, np.zeros(dim), np.zeros((dim, dim))
    for r in vectors.select("v").mapInArrow(each, schema).repartition(4).mapInArrow(merge, schema).collect():
        n, s, m = n + r.n, s + np.frombuffer(r.s), m + np.frombuffer(r.m).reshape(dim, dim)
    if not n:
        return np.eye(dim)
    m = m / n - (np.outer(s, s) / n**2 if centred else 0)
    _, axes = np.linalg.eigh((m + m.T) / 2)
    return np.ascontiguousarray(axes[:, ::-1])


def blocks(vectors: DataFrame, order: list[Column], count: int, dim: int, rows: int = BLOCK_ROWS, weighted: bool = False) -> DataFrame:
    """Rows in the given order, packed; blocks are numbered in that order. weighted:
    each id is followed by the row's ``weight``."""
    width = max(1, -(-count // rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        data: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal at
            i, x = np.concatenate(ids), np.concatenate(data)
            ids.clear()
            data.clear()
            at += 1
            return pa.RecordBatch.from_arrays([pa.array([part * (1 << 32) + at]), pa.array([len(i)], pa.int32()), pa.array([i.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=_BLOCK.names)

        for batch in batches:
            i, x = batch.column(0).to_numpy(), matrix(batch.column(1), dim)
            if weighted:
                i = np.stack([i, batch.column(2).to_numpy()], axis=1)
            while len(i):
                room = rows - sum(map(len, ids))
                ids.append(i[:room])
                data.append(x[:room])
                i, x = i[room:], x[room:]
                if sum(map(len, ids)) == rows:
                    yield flush()
        if ids:
            yield flush()

    ordered = vectors.repartitionByRange(width, *order).sortWithinPartitions(*order).select("id", "v", *(["weight"] if weighted else []))
    return durable(ordered.mapInArrow(run, _BLOCK))


def unpack(ids: pa.Scalar, data: pa.Scalar, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(data.as_buffer(), np.float32).reshape(-1, dim)
