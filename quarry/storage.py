"""The folder that driver and executors share."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests, a new local folder on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_file(uri: str, mode: str):
    """A file in the shared folder, from any worker: a mounted path directly, any other store through pyarrow."""
    place = urlparse(uri)
    if place.scheme in ("", "file"):
        if mode == "wb":
            os.makedirs(os.path.dirname(unquote(place.path)), exist_ok=True)
        return open(unquote(place.path), mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "wb":
        store.create_dir(os.path.dirname(path), recursive=True)
        return store.open_output_stream(path)
    return store.open_input_file(path)


def spread(df: DataFrame, task_bytes: int = 16 << 20) -> DataFrame:
    """df dealt over all cores if it is small, as one small file would be one task; larger inputs have tasks enough and are not moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * task_bytes else df


def arrow_batches(spark: SparkSession, rows: int = 2000, size: int = 16 << 20) -> None:
    """Bounds the batches that go to Python workers by rows and, where Spark can hold to it, by bytes; texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def checkpoints(spark: SparkSession) -> None:
    """Makes DataFrame.checkpoint() write to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, without temporary ones; none if it is not there."""
    place, store = _hadoop(spark, path)
    if not store.exists(place):
        return []
    return sorted(name for s in store.listStatus(place) if not (name := s.getPath().getName()).startswith((".", "_")))


def commit_file(spark: SparkSession, path: str, rows: list) -> None:
    """Writes a small list as JSON in one step: a file under another name that is then renamed, which fails where path exists already."""
    jvm = spark._jvm
    place, store = _hadoop(spark, path)
    store.mkdirs(place.getParent())
    held = jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_{uuid.uuid4().hex}")
    out = store.create(held, False)
    out.write(bytearray(json.dumps([list(r) if isinstance(r, tuple) else r for r in rows]).encode()))
    out.close()
    held, place = store.makeQualified(held), store.makeQualified(place)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(held, place, spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs.Options, "Rename"), 0))


def read_small(spark: SparkSession, path: str) -> list:
    """What commit_file() has written."""
    place, store = _hadoop(spark, path)
    stream = store.open(place)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    place, store = _hadoop(spark, path)
    store.delete(place, True)


def stamp(spark: SparkSession, path: str) -> tuple[int, int, int] | None:
    """(files, bytes, newest change) of a file or of all files under a folder; None if there is none."""
    place, store = _hadoop(spark, path)
    if not store.exists(place):
        return None
    files, size, newest, walk = 0, 0, 0, store.listFiles(place, True)
    while walk.hasNext():
        f = walk.next()
        files, size, newest = files + 1, size + f.getLen(), max(newest, f.getModificationTime())
    return (files, size, newest) if files else None
