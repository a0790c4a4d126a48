"""What charts are drawn from: group means and bins, all charts of a frame in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.retrieval import six


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """A value's bin from 0; the last bin holds its upper end, values beyond the ends and null have none."""
    at = F.least(F.floor((value - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return F.when((value >= low) & (value <= high), at)


def chart_frames(rows: DataFrame, charts: dict[str, list[str]], metrics: list[str]) -> DataFrame:
    """(chart, dimensions..., n, <metric>, <metric>_std, <metric>_n): each chart's group means and deviations, for charts that name their dimensions.

    All charts are grouping sets of one aggregate, so the rows are read and shuffled once, combined beforehand. A
    dimension that a chart does not have is null in its rows; a group whose own value is null is left out, as a
    bar without a name. Means are over values that are there.
    """
    names = sorted({d for dims in charts.values() for d in dims})
    sets = {name: sum((d not in dims) << (len(names) - 1 - i) for i, d in enumerate(names)) for name, dims in charts.items()}
    measures = [x for m in metrics for x in (six(F.avg(m)).alias(m), six(F.coalesce(F.stddev_samp(m), F.lit(0.0))).alias(f"{m}_std"), F.count(m).alias(f"{m}_n"))]
    distinct = list({tuple(sorted(dims)) for dims in charts.values()})
    grouped = rows.groupingSets([[F.col(c) for c in dims] for dims in distinct], *[F.col(c) for c in names]).agg(F.grouping_id().alias("__set"), F.count("*").alias("n"), *measures)
    which = F.array(*[F.struct(F.lit(name).alias("chart"), F.lit(code).alias("code")) for name, code in sets.items()])
    named = grouped.withColumn("__c", F.explode(F.filter(which, lambda x: x["code"] == F.col("__set"))))
    missing = F.lit(False)
    for i, d in enumerate(names):
        missing = missing | (F.col(d).isNull() & (F.shiftright("__set", len(names) - 1 - i).bitwiseAND(F.lit(1)) == 0))
    return named.where(~missing).select(F.col("__c.chart").alias("chart"), *names, "n", *[c for m in metrics for c in (m, f"{m}_std", f"{m}_n")])


def heat_map(frame: DataFrame, chart: str, row: str, column: str, columns: list, metric: str) -> DataFrame:
    """A row a value of row and a column a value of column, out of chart_frames(); cells without rows are null."""
    return frame.where(F.col("chart") == chart).groupBy(row).pivot(column, columns).agg(F.max(metric))
