"""Helpers shared by the training-data operators: the shared folder, staged tables, bounded batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.storage import remove

#: Rows in an Arrow batch handed to Python; documents are a few KB, so a batch is a few MB.
ARROW_ROWS = 2000
#: Bytes in such a batch, where Spark can hold to it.
ARROW_BYTES = 16 << 20
#: Bytes of text that one Python step holds at a time.
SLICE_BYTES = 4 << 20

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Java and RE2 pattern of a word; its complement is what bytes.split() splits at.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a new local one on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{(_scratch.get() or shared_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession):
    """What is staged inside is removed at the end; a table that is read later needs a path from before."""
    folder = new_path(spark, "scratch")
    before = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(before)
        remove(spark, folder)


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder, or to a path there, and read it back."""
    spark, schema = df.sparkSession, df.schema
    path = path or new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def arrow_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers; texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def slices(sizes, limit: int = SLICE_BYTES):
    """(start, stop) of consecutive runs whose sizes add up to about limit; a larger item stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def ascii_lower(col):
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
