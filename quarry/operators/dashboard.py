"""What a dashboard shows, as reshapes of the experiment's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds of models in order.
MODELS = ["ols", "rf", "xgb"]


def model_comparison(errors: DataFrame) -> DataFrame:
    """(metric, ols_mae, rf_mae, xgb_mae, ols_r2, best_model, best_mae) of errors(model, metric, mae, r2): an error that is missing is 0 and never the best; of equal ones the first model is."""
    at = lambda m, c: F.coalesce(F.max(F.when(F.col("model") == m, F.col(c))), F.lit(0.0))
    wide = errors.where(F.col("metric").isNotNull()).groupBy("metric").agg(*[at(m, "mae").alias(f"{m}_mae") for m in MODELS], at("ols", "r2").alias("ols_r2"))
    known = F.filter(F.array(*[F.struct(F.col(f"{m}_mae").alias("mae"), F.lit(i).alias("i"), F.lit(m).alias("model")) for i, m in enumerate(MODELS)]), lambda x: x["mae"] > 0)
    best = F.get(F.array_sort(known), F.lit(0))
    return wide.select("*", best["model"].alias("best_model"), best["mae"].alias("best_mae"))


def importances(weights: DataFrame) -> DataFrame:
    """(metric, model, place, feature, importance) of weights(metric, model, feature, importance), the largest first, ties by feature; a model's features are few."""
    top = F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("i"), "feature")))
    lists = weights.where(F.col("importance").isNotNull()).groupBy("metric", "model").agg(top.alias("x"))
    each = lists.select("metric", "model", F.posexplode("x").alias("p", "x"))
    return each.select("metric", "model", (F.col("p") + 1).alias("place"), "x.feature", (-F.col("x.i")).alias("importance"))


def validation_counts(held_out: DataFrame) -> DataFrame:
    """(domain, boundary_conditions, n, reliable) of held_out(metric, condition_id, domain, actual, predicted, low, high, is_boundary)."""
    n = F.count_if("is_boundary")
    return held_out.groupBy("domain").agg(n.alias("boundary_conditions"), F.count("*").alias("n"), (n == 0).alias("reliable"))


def boundaries(held_out: DataFrame) -> DataFrame:
    """The rows of held_out that lie beyond their boundary, without the mark."""
    return held_out.where("is_boundary").drop("is_boundary")


def summary(errors: DataFrame, held_out: DataFrame, agreement: DataFrame, threshold: float = 0.70) -> DataFrame:
    """One row: conditions, domains, metrics (metric to mae and r2 of the regression), boundary_conditions (by domain), kappa (mean), threshold_met, kappa_by_pair.

    agreement(pair, kappa) may be empty: kappa and threshold_met are then null, as nothing was rated.
    """
    pairs = lambda rows, k, v: rows.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(k, v)))).alias("m"))
    ols = errors.where("model = 'ols'").select("metric", F.struct(F.coalesce("mae", F.lit(0.0)).alias("mae"), F.coalesce("r2", F.lit(0.0)).alias("r2")).alias("v"))
    parts = [
        pairs(ols, "metric", "v").withColumnRenamed("m", "metrics"),
        pairs(validation_counts(held_out).where("boundary_conditions > 0").select("domain", F.col("boundary_conditions").alias("v")), "domain", "v").withColumnRenamed("m", "boundary_conditions"),
        held_out.agg(F.countDistinct("condition_id").alias("conditions"), F.countDistinct("domain").alias("domains")),
        agreement.agg(F.round(F.avg("kappa"), 4).alias("kappa"), (F.avg("kappa") >= threshold).alias("threshold_met"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("pair", "kappa")))).alias("kappa_by_pair")),
    ]
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(p)  # one row each
    return one


def health(spark, artifacts: dict[str, str]) -> DataFrame:
    """(name, present, files, bytes) of artifacts by name and path."""
    from quarry.storage import stamp

    found = {n: stamp(spark, p) for n, p in artifacts.items()}
    return spark.createDataFrame([(n, s is not None, s[0] if s else 0, s[1] if s else 0) for n, s in found.items()], "name string, present boolean, files int, bytes long")
