"""Checkpoints in the shared folder, and arguments that are checked once."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where none is set, one of this machine, if Spark is all in it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = _own.setdefault("dir", None) or tempfile.mkdtemp(prefix="ckpt-")
        _own["dir"] = at
    return at


_own: dict = {}


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint()


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside sends Arrow batches of so many rows at most; then the session's own setting holds again."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)
