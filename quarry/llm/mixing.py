"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / size copies. Within its source, documents are put in order of
size, the expected copies are summed along that order, one offset is added, and a document is emitted once
for each integer that the sum crosses. Order by size keeps the words taken close to the target. The running
sum is made in two passes over range-partitioned rows, so that a source may hold any share of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._common import WORD, staged


def word_count(col):
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(source, source_size, target) from sizes(source, source_size), one row a source.

    Sources by code point, null last, get the weights in turn, and share the total size by weight. A target
    stops at cap times its source's size, and the excess is shared again by weight until none is above: the
    level at which the targets min(cap * size, level * weight) add up to the total. Sources are ranked in one
    task, as rows of the aggregated table of sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("w", weight.cast("long")).withColumn("top", (F.lit(cap) * F.col("source_size")).cast("long"))
    by_ratio = Window.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = (
        ranked.withColumn("spent", F.coalesce(F.sum("top").over(by_ratio), F.lit(0)))
        .withColumn("used", F.coalesce(F.sum("w").over(by_ratio), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("weight", F.sum("w").over(every))
        .withColumn("level", (F.col("total") - F.col("spent")).cast("double") / (F.col("weight") - F.col("used")).cast("double"))
    )
    # the level is that of the first source, by ratio, whose cap lies above it
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("top"), F.struct(F.col("top") / F.col("w"), F.col("level").alias("level")))).over(every)
    ranked = ranked.withColumn("at", level["level"])
    share = F.coalesce(F.col("at") * F.col("w"), F.col("top").cast("double"))
    return ranked.select("source", "source_size", F.least(F.col("top").cast("double"), share).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix") -> DataFrame:
    """One row per input row: id_col, source, size, source_size, target, copies, taken (size times copies).

    copies is how often the mix holds the row, at most cap; reruns agree, for any number of partitions. A null
    source is a source of its own; null, empty and blank texts have size 0 and take part like others. Ties in
    size go by id (null first) and text hash. Repeated rows each get their own share. A source whose size is 0
    has target 0 and no copies. Other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("tie"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "source", "size", "id", "tie").withColumn("part", F.spark_partition_id())
    ordered = staged(ordered, "sizes")
    counts = ordered.groupBy("source", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    sums = counts.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sums, weights, cap)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("\x00")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    known = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select(
        F.col("o.source").alias("s"), F.col("part").alias("p"), "before", "source_size", "target"
    )
    known = known.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0)))
    inside = Window.partitionBy("part", "source").orderBy("size", "id", "tie")
    numbered = ordered.withColumn("rn", F.row_number().over(inside))
    both = numbered.join(known, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    place = (F.col("before") + F.col("rn")).cast("double")
    crossed = F.floor(place * F.col("rate") + drawn) - F.floor((place - 1) * F.col("rate") + drawn)
    copies = F.least(crossed, F.lit(cap)).cast("long")
    return both.select(F.col("id").alias(id_col), "source", "size", F.col("source_size").cast("long"), "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
