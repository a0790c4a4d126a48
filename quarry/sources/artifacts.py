"""Artifacts: tables that experiments leave behind, read once, and published as a set that changes in one step."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.storage import child_names, commit_file, read_small, stamp

#: Formats by the end of a name; other names are Parquet tables.
FORMATS = {".json": "json", ".csv": "csv"}


def _a_record_a_line(spark: SparkSession, path: str) -> bool:
    """Whether a JSON artifact's first line is a whole record; if not, records go over lines or the file is an array."""
    first = spark.read.text(path).where("trim(value) <> ''").first()
    try:
        return first is not None and isinstance(json.loads(first["value"]), dict)
    except ValueError:
        return False


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """An artifact by its name: JSON of either layout, CSV with a header, else Parquet."""
    kind = next((f for end, f in FORMATS.items() if path.endswith(end)), "parquet")
    options = {"header": "true", "multiLine": "true", "escape": '"'} if kind == "csv" else {"multiLine": str(not _a_record_a_line(spark, path)).lower()} if kind == "json" else {}
    return spark.read.format(kind).options(**options).load(path)


def write_table(df: DataFrame, path: str) -> None:
    """Replaces an artifact by its name, as read_table() reads it: JSON (a record a line), CSV with a header, else Parquet.

    CSV has no nested values, so arrays, maps and structs become JSON text in it. The files are written by the
    tasks that hold the rows.
    """
    kind = next((f for end, f in FORMATS.items() if path.endswith(end)), "parquet")
    if kind == "csv":
        nested = {f.name: F.to_json(F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
        df.withColumns(nested).write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)
    else:
        df.write.mode("overwrite").format(kind).save(path)


class Artifacts:
    """Artifacts that are read once while they stay as they are: an entry is known by path, length and time of change.

    A missing artifact is an error that names it. One that has changed is read anew, and what was held of it is
    let go. A table is persisted in the executors on first use; large ones spill to their disks.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.held, self.reads = spark, {}, 0

    def get(self, path: str) -> DataFrame:
        now = stamp(self.spark, path)
        if now is None:
            self.drop(path)
            raise FileNotFoundError(f"required artifact missing: {path}; publish it first")
        if path not in self.held or self.held[path][0] != now:
            self.drop(path)
            self.held[path] = (now, read_table(self.spark, path).persist())
            self.reads += 1
        return self.held[path][1]

    def drop(self, path: str) -> None:
        if path in self.held:
            self.held.pop(path)[1].unpersist()

    def clear(self) -> None:
        for path in list(self.held):
            self.drop(path)


def published(spark: SparkSession, target: str) -> dict[str, str]:
    """Name and path of every artifact of the set in force."""
    names = child_names(spark, f"{target}/manifest")
    return {n: p for n, p in read_small(spark, f"{target}/manifest/{max(names)}")} if names else {}


def publish(spark: SparkSession, sources: dict[str, str], target: str, partial: bool = True) -> DataFrame:
    """Copies artifacts (name, source path) to target and switches to them; returns (name, status, path), a row a name.

    Each is copied by a job of its own to a new folder; the manifest is written last, as one file. A copy that
    fails, or a run that dies, leaves the set in force as it was, and its readers go on reading. A missing source
    is reported; with partial the others are published and what was published under its name before stays, else
    nothing changes. status is copied, missing, or kept back (not switched as another is missing).
    """
    found = {n: stamp(spark, p) is not None for n, p in sources.items()}
    missing = [n for n, there in found.items() if not there]
    old = published(spark, target)
    if missing and not partial:
        return _report(spark, [(n, "kept back" if found[n] else "missing", old.get(n)) for n in sources])
    folder = f"{target}/sets/{uuid.uuid4().hex}"
    new = {}
    for n, p in sources.items():
        if found[n]:
            new[n] = f"{folder}/{n}"
            read_table(spark, p).write.parquet(new[n])
    if new:
        names = child_names(spark, f"{target}/manifest")
        commit_file(spark, f"{target}/manifest/{(int(max(names)) + 1 if names else 0):012d}", sorted((old | new).items()))
    return _report(spark, [(n, "copied" if n in new else "missing", (old | new).get(n)) for n in sources])


def _report(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, "name string, status string, path string")
