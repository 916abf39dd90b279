"""Cutting lineage in storage that outlives executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the cluster's folder (``spark.checkpoint.dir``), in one of our own only where none is named."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master or "").startswith("local"):
            raise RuntimeError("a cluster names its shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()
