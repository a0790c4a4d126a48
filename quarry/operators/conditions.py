"""Age windows and the condition corpora cut with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import dates, text
from quarry.operators.quality import cleaned, first_wins, quality_reasons
from quarry.schema import VOLATILITY_DAYS, conditions, lookup
from quarry.storage import checkpoints


def effective_age(age: Column, domain: Column, label: Column) -> Column:
    """The age that a window is tested against: in adjusted windows it is scaled by the domain's decay over 180 days."""
    scale = lookup(VOLATILITY_DAYS, domain, 180).cast("double") / 180.0
    return F.when(F.contains(label, F.lit("adj")), age * scale).otherwise(age)


def in_window(age: Column, least: Column, most: Column) -> Column:
    """Inclusive at both ends; no upper end where most is null; never without an age."""
    return F.coalesce((age >= least) & (most.isNull() | (age <= most)), F.lit(False))


def count_in_window(docs: DataFrame, least: int, most: int | None, as_of: str) -> DataFrame:
    age = dates.age_days(F.col("publication_date"), as_of)
    return docs.agg(F.count_if(in_window(age, F.lit(least), F.lit(most).cast("int"))).alias("n"))


def prioritize(docs: DataFrame, least: int, most: int | None, as_of: str, strict: bool = False, seq: str = "seq") -> DataFrame:
    """Rows of the window first (or only), in their order; adds position."""
    age = dates.age_days(F.col("publication_date"), as_of)
    marked = docs.withColumn("in_window", in_window(age, F.lit(least), F.lit(most).cast("int")))
    if strict:
        marked = marked.where("in_window")
    return marked.orderBy(F.col("in_window").desc(), seq)


def prioritized_places(docs: DataFrame, least: int, most: int | None, as_of: str, by: list[str], seq: str = "seq") -> DataFrame:
    """(seq, by..., in_window, place): prioritize() as places from 1 within by, without bringing a group into one task."""
    from quarry.operators.order import positions

    age = dates.age_days(F.col("publication_date"), as_of)
    light = docs.select(seq, *by, F.coalesce(in_window(age, F.lit(least), F.lit(most).cast("int")), F.lit(False)).alias("in_window"))
    placed = positions(light.withColumn("__late", ~F.col("in_window")), by, ["__late", seq], "__place")
    return placed.select(seq, *by, "in_window", (F.col("__place") + 1).cast("int").alias("place"))


def candidates(docs: DataFrame, as_of: str) -> DataFrame:
    """Rows by condition: the condition's source types, in its order, and its age window. The dimension has twelve rows and is broadcast."""
    dim = conditions(docs.sparkSession).select("position", "condition_id", F.col("domain").alias("condition_domain"), F.col("freshness_label").alias("condition_label"), "min_age_days", "max_age_days", "source_configuration", F.posexplode("source_mix").alias("source_pos", "mix"))
    aged = docs.withColumn("age_days", dates.age_days(F.col("publication_date"), as_of))
    both = aged.join(F.broadcast(dim), (F.col("domain") == F.col("condition_domain")) & (F.col("source_type") == F.col("mix")))
    effective = effective_age(F.col("age_days"), F.col("domain"), F.col("condition_label"))
    return both.where(in_window(effective, F.col("min_age_days"), F.col("max_age_days")))


def build_conditions(docs: DataFrame, as_of: str, target: int, seq: str = "seq") -> DataFrame:
    """Condition rows: the first of each address (or title and date) within a condition, the first target of them by source order and seq."""
    rows = candidates(docs, as_of)
    link = F.lower(F.trim(text.text_or_empty(F.col("url"))))
    key = F.concat_ws("|", "condition_id", F.when(link != "", link).otherwise(F.concat_ws("::", "title", "publication_date")))
    kept = first_wins(rows, key, [F.col("source_pos"), F.col(seq)], "__first").where("__first").drop("__first")
    rank = F.row_number().over(Window.partitionBy("condition_id").orderBy("source_pos", seq))
    return kept.withColumn("rank", rank).where(F.col("rank") <= target)


def combined(condition_rows: DataFrame, keywords: dict | None = None) -> DataFrame:
    """All conditions in order, through the quality cascade: of a record that several share, the first condition's copy stays.

    The conditions' rows, which their limits bound, are made once for both passes.
    """
    checkpoints(condition_rows.sparkSession)
    rows = condition_rows.withColumn("condition_place", F.struct("position", "rank")).checkpoint()
    kept = quality_reasons(rows, keywords, seq="condition_place").where("reason IS NULL").select("condition_place")
    return cleaned(rows).join(kept, "condition_place", "left_semi").drop("condition_place")
