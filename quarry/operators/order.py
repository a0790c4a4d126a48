"""Order statistics of groups of any size: ranks by distinct values, in two passes over range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.storage import new_path


def cumulative(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., value, n, before, total): each distinct value of a group with how often it occurs, how many values are less, and how many there are.

    Equal values are counted first, so that a value that a third of all rows share is one row. The distinct ones
    are range partitioned, so that a group goes over many tasks; sums within a partition and the offsets of the
    partitions before make the ranks. Null and NaN values are left out.
    """
    spark = rows.sparkSession
    v = F.col(value).cast("double")
    counted = rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("value")).agg(F.count("*").alias("n"))
    path = new_path(spark, "ordered")
    # written, so that a partition's number stays what it is
    counted.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by, "value").withColumn("__part", F.spark_partition_id()).write.parquet(path)
    ordered = spark.read.parquet(path)
    parts = ordered.groupBy(*by, "__part").agg(F.sum("n").alias("__n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    earlier = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"), F.sum("__n").over(group).alias("total"))
    rule = F.col("__part") == F.col("__p")
    for b in by:
        rule = rule & F.col(b).eqNullSafe(F.col(f"__{b}"))
    inside = Window.partitionBy("__part", *by).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ordered.withColumn("__inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return ranked.join(offsets, rule).select(*by, "value", "n", (F.col("__offset") + F.col("__inside")).alias("before"), "total")


def at_rank(rank: Column) -> Column:
    """Of cumulative() rows: the value at a rank from 1, as an aggregate over its group."""
    return F.max(F.when((F.col("before") < rank) & (rank <= F.col("before") + F.col("n")), F.col("value")))


def medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., n, median) without bringing a group into one task: the middle value, or the mean of the two."""
    t = F.col("total")
    low, high = at_rank(F.floor((t + 1) / 2)), at_rank(F.floor(t / 2) + 1)
    return cumulative(rows, by, value).groupBy(*by).agg(F.max("total").alias("n"), ((low + high) / 2).alias("median"))


def positions(rows: DataFrame, by: list[str], order: list[str], name: str = "position") -> DataFrame:
    """rows with their place in order within by, from 0, and how many there are in <name>_of; the columns of order must name a row within by.

    Rows are range partitioned by group and order, so that no group has to meet in one task; what stands before a
    partition is added from counts.
    """
    spark = rows.sparkSession
    path = new_path(spark, "placed")
    rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by, *order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    ordered = spark.read.parquet(path)
    parts = ordered.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    earlier = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"), F.sum("__n").over(group).alias(f"{name}_of"))
    rule = F.col("__part") == F.col("__p")
    for b in by:
        rule = rule & F.col(b).eqNullSafe(F.col(f"__{b}"))
    inside = F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order))
    ranked = ordered.withColumn("__inside", inside).join(offsets, rule)
    return ranked.select(*rows.columns, (F.col("__offset") + F.col("__inside") - 1).alias(name), f"{name}_of")
