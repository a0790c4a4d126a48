"""An experiment as named stages, each a table under one folder: a run goes on after the last stage that is whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.storage import child_names, commit_file, read_small, remove


def stage_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table of a stage that is whole; a stage that is not is an error that names it."""
    if name not in child_names(spark, f"{base}/commits"):
        raise FileNotFoundError(f"stage {name} has not been run under {base}")
    return spark.read.parquet(read_small(spark, f"{base}/commits/{name}")[0])


def run_stages(spark: SparkSession, stages: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]], base: str, only: list[str] | None = None, force: bool = False) -> DataFrame:
    """Runs stages in order and returns (stage, status, rows, error), a row a stage.

    A stage's function gets the tables of the stages before it by name. Its table is written first and committed
    by one small file after, so that a stage whose run dies is made again, and one that is whole is kept. only
    names the stages to run; others are kept if they are there, else missing. With force, stages that run are
    made anew, and so are those after one that was. A stage that fails is reported; those after it are skipped.
    """
    tables: dict[str, DataFrame] = {}
    report, anew, broken = [], force, False
    for name, work in stages:
        there = name in child_names(spark, f"{base}/commits")
        if broken:
            report.append((name, "skipped", None, None))
            continue
        if there and (not anew or (only is not None and name not in only)):
            tables[name] = stage_table(spark, base, name)
            report.append((name, "kept", tables[name].count(), None))
            continue
        if only is not None and name not in only:
            report.append((name, "missing", None, None))
            broken = True
            continue
        place = f"{base}/tables/{name}-{uuid.uuid4().hex}"
        try:
            work(dict(tables)).write.parquet(place)
        except Exception as e:
            report.append((name, "failed", None, str(e).splitlines()[0][:200]))
            broken = True
            continue
        remove(spark, f"{base}/commits/{name}")
        commit_file(spark, f"{base}/commits/{name}", [place])
        tables[name], anew = stage_table(spark, base, name), True
        report.append((name, "made", tables[name].count(), None))
    return spark.createDataFrame(report, "stage string, status string, rows long, error string")
