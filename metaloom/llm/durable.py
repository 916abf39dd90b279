"""Cutting lineage in storage that outlives executors, and memory of workers that live on."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the folder that the cluster names in
    ``spark.checkpoint.dir``; a folder of our own only where none is named."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def shuffle_width(df: DataFrame) -> int:
    """Partitions that this session gives a shuffle."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A task's function that gives the memory it freed back to the machine at its end:
    Python workers are used again, and idle ones would keep it."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped
