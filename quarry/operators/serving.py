"""From fitted coefficients to predictions and recommendations, as joins of small tables with requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.dates import freshness_half_life
from quarry.schema import SOURCE_LEVELS, UNKNOWN_VOLATILITY, VOLATILITY_SCORE, lookup

#: Beyond this source diversity no training row lay.
SDI_MAX = 0.45
# Weights of the readiness score, and the least and greatest value of a metric.
READINESS = {"precision_at_5": 0.35, "bertscore_f1": 0.30, "hallucination_rate": 0.20, "ndcg_at_5": 0.15}
SCALE = {"human_eval_score": (1.0, 5.0)}
LOWER_IS_BETTER = ["hallucination_rate"]
# What is said about a configuration.
POLLUTION = "Source pollution: in this domain the most diverse source mix measured lower retrieval precision than a leaner mix. Consider dropping noisier sources."
UNDERPERFORMS = ("The selected source mix underperforms the best measured mix (", ") for this domain.")
NO_RISK = "No significant risks detected for this configuration."
TIER_OF_CONFIG = {"academic": 0, "single": 0, "academic+news": 1, "mix": 1, "full": 2}


def clamp_metric(metric: Column, value: Column) -> Column:
    return F.when(metric == "human_eval_score", F.greatest(F.lit(1.0), F.least(F.lit(5.0), value))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def four(value: Column) -> Column:
    """Rounded to four places as a decimal number, so that halves go up whatever the double's last bits are."""
    return F.round(value.cast("decimal(20,9)"), 4).cast("double")


def three(name: str) -> Column:
    """A value as text with three places, rounded as four() does."""
    return F.round(F.col(name).cast("decimal(20,9)"), 3).cast("string")


def feature_values(requests: DataFrame) -> dict[str, Column]:
    """A request's features by name, of requests(domain, avg_age_days, sdi); a missing age is 30 days."""
    vol = lookup(VOLATILITY_SCORE, F.lower("domain"), UNKNOWN_VOLATILITY)
    f = freshness_half_life(F.coalesce(F.col("avg_age_days").cast("double"), F.lit(30.0)))
    s = F.col("sdi")
    return {"intercept": F.lit(1.0), "freshness_score": f, "source_diversity_index": s, "domain_volatility": vol, "fresh_x_diversity": f * s, "fresh_x_volatility": f * vol, "source_x_volatility": s * vol, "freshness_score_sq": f * f, "source_diversity_index_sq": s * s, "domain_volatility_sq": vol * vol}


def predict(requests: DataFrame, coefficients: DataFrame, bounds: DataFrame) -> DataFrame:
    """(request_id, metric, expected, lower, upper, mae) from coefficients(metric, feature, coef) and bounds(metric, mae).

    A coefficient set without squares leaves them out, and a feature that a request lacks adds nothing. Both tables
    have a row per metric and feature; they become a row a metric, which is broadcast by name: a table made of
    local rows has no size by which Spark would choose it, and requests of a small file look smaller than they
    are. Requests meet by their id, and what follows by that id needs no other shuffle.
    """
    features = feature_values(requests)
    wide = requests.select("request_id", *[v.cast("double").alias(f"x_{k}") for k, v in features.items()]).groupBy("request_id").agg(*[F.sum(f"x_{k}").alias(f"x_{k}") for k in features])
    known = coefficients.where(F.col("feature").isin(list(features)) & F.col("metric").isNotNull())
    model = known.groupBy("metric").agg(*[F.sum(F.when(F.col("feature") == k, F.col("coef"))).alias(f"c_{k}") for k in features]).join(bounds, "metric")
    products = [F.col(f"c_{k}") * F.col(f"x_{k}") for k in features]
    total = F.lit(0.0)
    for x in products:
        total = total + F.coalesce(x, F.lit(0.0))
    sums = wide.crossJoin(F.broadcast(model)).select("request_id", "metric", F.when(F.coalesce(*products).isNotNull(), total).alias("raw"), "mae")
    m = F.col("metric")
    # rounded once finely, so that the order of summing does not decide a half
    v = clamp_metric(m, F.round("raw", 9))
    return sums.select("request_id", "metric", four(v).alias("expected"), four(clamp_metric(m, v - F.col("mae"))).alias("lower"), four(clamp_metric(m, v + F.col("mae"))).alias("upper"), F.round("mae", 4).alias("mae"))


def warning(sdi: Column) -> Column:
    """What is said of a diversity beyond the training range; null within it."""
    return F.when(sdi > SDI_MAX, F.concat(F.lit("Source diversity index "), F.format_number(sdi, 2), F.lit(" lies beyond the training range.")))


def source_tiers(metrics: DataFrame, values: list[str]) -> DataFrame:
    """(domain, tier, sdi, n_conditions, values...): conditions of a domain with the same diversity (to 4 decimals) are one tier, from 0 up."""
    from pyspark.sql import Window

    found = metrics.groupBy("domain", F.round("sdi", 4).alias("__s")).agg(F.round(F.avg("sdi"), 4).alias("tier_sdi"), F.count("*").alias("n_conditions"), *[F.round(F.avg(v), 4).alias(v) for v in values])
    tier = F.dense_rank().over(Window.partitionBy("domain").orderBy("__s")) - 1
    return found.select("domain", tier.alias("tier"), "tier_sdi", "n_conditions", *values)


def resolve_sdi(requests: DataFrame, tiers: DataFrame) -> DataFrame:
    """Requests with sdi: their own, else that of the tier their configuration asks for, the highest there is at most.

    Three tiers a domain can be asked for; they go to the requests, which stay where they are.
    """
    top = tiers.groupBy(F.col("domain").alias("td")).agg(F.max("tier").alias("most"))
    asked = requests.join(F.broadcast(top), F.col("domain") == F.col("td"), "left").withColumn("want", F.least(lookup(TIER_OF_CONFIG, F.col("source_config"), 0), F.coalesce("most", F.lit(0))))
    own = tiers.where(F.col("tier") <= max(TIER_OF_CONFIG.values())).select(F.col("domain").alias("d2"), F.col("tier").alias("t2"), "tier_sdi")
    both = asked.join(F.broadcast(own), (F.col("domain") == F.col("d2")) & (F.col("want") == F.col("t2")), "left")
    return both.select(*[c for c in requests.columns if c != "sdi"], F.col("want").alias("tier"), F.coalesce(F.col("sdi") if "sdi" in requests.columns else F.lit(None).cast("double"), "tier_sdi", F.lit(0.0)).alias("sdi"))


def tier_summary(tiers: DataFrame, metric: str) -> DataFrame:
    """(domain, best_tier, best, worst_tier, worst, delta_pct, pollution): the lowest tier wins ties; pollution is a top tier below a leaner one."""
    m, t = F.col(metric), F.col("tier")
    best, worst, top = F.max(F.struct(m, -t)), F.min(F.struct(m, t)), F.max(F.struct(t, m))
    lean = F.collect_list(F.struct(t, m))
    s = tiers.where(m.isNotNull()).groupBy("domain").agg(best.alias("b"), worst.alias("w"), top.alias("p"), lean.alias("l"))
    b, w = F.col("b")[metric], F.col("w")[metric]
    pollution = F.exists("l", lambda x: (x["tier"] < F.col("p.tier")) & (x[metric] > F.col("p")[metric]))
    return s.select("domain", (-F.col("b.col2")).alias("best_tier"), b.alias("best"), F.col("w.tier").alias("worst_tier"), w.alias("worst"), F.when(w > 0, F.round(100 * (b - w) / w, 1)).alias("delta_pct"), pollution.alias("pollution"))


def cadence(volatility: Column) -> Column:
    return F.when(volatility >= 0.75, "Weekly").when(volatility >= 0.25, "Monthly").otherwise("Quarterly")


def normalized(metric: Column, value: Column) -> Column:
    """From 0 to 1, where 1 is best."""
    low, high = F.when(metric == "human_eval_score", 1.0).otherwise(0.0), F.when(metric == "human_eval_score", 5.0).otherwise(1.0)
    n = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))
    return F.when(metric.isin(LOWER_IS_BETTER), 1 - n).otherwise(n)


def readiness_score() -> Column:
    """Of a request's predictions, as an aggregate: the weighted mean of normalized metrics as an integer percentage, halves to even; null without a metric that weighs."""
    w = F.when(F.col("expected").isNotNull(), lookup(READINESS, F.col("metric")).cast("double"))
    # rounded once finely, so that the order of summing does not decide a half
    return F.bround(F.round(100 * F.sum(w * normalized(F.col("metric"), F.col("expected"))) / F.sum(w), 9)).cast("int")


def readiness(predictions: DataFrame) -> DataFrame:
    """(request_id, readiness) of requests with a metric that weighs."""
    return predictions.groupBy("request_id").agg(readiness_score().alias("readiness")).where("readiness IS NOT NULL")


def level_name(tier: Column) -> Column:
    return F.when(tier == 0, SOURCE_LEVELS[0]).when(tier == 1, SOURCE_LEVELS[1]).otherwise(SOURCE_LEVELS[2])


def recommendations(requests: DataFrame, predictions: DataFrame, tiers: DataFrame, metric: str = "precision_at_5") -> DataFrame:
    """(request_id, cadence, readiness, best_tier, tier, underperforms, pollution_risk, warning, performance_range, risks, key_finding), a row per request.

    What predictions say of a request is one aggregate, so they are worked out once; they meet requests by a
    merge, as Spark would take a small file's requests for a table to broadcast. What is said of a domain's tiers is broadcast.
    """
    summary = tier_summary(tiers, metric)
    at = tiers.select(F.col("domain").alias("d3"), F.col("tier").alias("t3"), F.col(metric).alias("own"))
    both = requests.join(F.broadcast(summary), "domain", "left").join(F.broadcast(at), (F.col("domain") == F.col("d3")) & (F.col("tier") == F.col("t3")), "left")
    own = F.max(F.when(F.col("metric") == metric, F.struct("expected", "lower", "upper"))).alias("own_band")
    told = predictions.groupBy("request_id").agg(readiness_score().alias("readiness"), own)
    told = told.select("request_id", "readiness", *[F.col(f"own_band.{c}").alias(c) for c in ("expected", "lower", "upper")])
    band = F.format_string("Expected Precision@5: %s (95%% band %s-%s)", three("expected"), three("lower"), three("upper"))
    both = both.join(told.hint("merge"), "request_id", "left").withColumns({"warning": warning(F.col("sdi")), "performance_range": F.when(F.col("expected").isNotNull(), band)})
    vol = lookup(VOLATILITY_SCORE, F.lower("domain"), UNKNOWN_VOLATILITY)
    under = F.coalesce(F.col("own") < F.col("best"), F.lit(False))
    polluted = F.coalesce(F.col("pollution") & (F.col("source_config") == "full"), F.lit(False))
    best, worst = level_name(F.col("best_tier")), level_name(F.col("worst_tier"))
    told = F.array_compact(F.array(F.when(polluted, POLLUTION), F.when(under, F.concat(F.lit(UNDERPERFORMS[0]), best, F.lit(UNDERPERFORMS[1]))), F.col("warning")))
    finding = F.format_string("Source mix matters here: moving from %s (%s) to %s (%s) changes Precision@5 by %+.1f%%.", worst, three("worst"), best, three("best"), "delta_pct")
    return both.select(
        "request_id", cadence(vol).alias("cadence"), F.coalesce("readiness", F.lit(0)).alias("readiness"), "best_tier", "tier", under.alias("underperforms"), polluted.alias("pollution_risk"), "warning",
        F.coalesce("performance_range", F.lit("")).alias("performance_range"), F.when(F.size(told) > 0, told).otherwise(F.array(F.lit(NO_RISK))).alias("risks"), F.when(F.col("delta_pct").isNotNull(), finding).otherwise("").alias("key_finding"),
    )


def sensitivity(domains: DataFrame, coefficients: DataFrame, bounds: DataFrame) -> DataFrame:
    """(domain, sensitivity) of domains(domain, sdi): how far Precision@5 moves from documents of 3 days to documents of 365."""
    found = freshness_sweep(domains, [3, 365], coefficients, bounds).where("metric = 'precision_at_5'")
    at = lambda a: F.coalesce(F.max(F.when(F.col("avg_age_days") == a, F.col("expected"))), F.lit(0.0))
    return found.groupBy("domain").agg(F.round(F.abs(at(3) - at(365)), 4).alias("sensitivity"))


def guidelines(tiers: DataFrame, coefficients: DataFrame, bounds: DataFrame, boundaries: DataFrame, metric: str = "precision_at_5") -> DataFrame:
    """A row a domain: volatility, cadence, sensitivity, best level, pollution, what is predicted for documents of 90 days, and whether no boundary condition speaks against it.

    boundaries(domain, boundary_conditions) may lack domains, whose reliability is then unknown.
    """
    best = tier_summary(tiers, metric).select("domain", F.col("best_tier").alias("tier"), "pollution")
    rep = best.join(tiers.select("domain", "tier", F.col("tier_sdi").alias("sdi")), ["domain", "tier"])
    expected = freshness_sweep(rep, [90], coefficients, bounds).groupBy("domain").agg(*[F.max(F.when(F.col("metric") == m, F.col("expected"))).alias(m) for m in ("precision_at_5", "hallucination_rate", "bertscore_f1")])
    both = rep.join(expected, "domain", "left").join(sensitivity(rep, coefficients, bounds), "domain", "left").join(boundaries, "domain", "left")
    vol = lookup(VOLATILITY_SCORE, F.col("domain"), UNKNOWN_VOLATILITY).cast("double")
    return both.select("domain", vol.alias("volatility"), cadence(vol).alias("cadence"), "sensitivity", level_name(F.col("tier")).alias("best_source_level"), "pollution", "precision_at_5", "hallucination_rate", "bertscore_f1", "boundary_conditions", (F.col("boundary_conditions") == 0).alias("reliable"))


def best_fit(fits: DataFrame, by: str, order: list[str]) -> DataFrame:
    """(by, curve, r2): the curve with the largest R2, the first in order where it is shared."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("curve"))
    top = fits.groupBy(by).agg(F.max(F.struct("r2", -place, "curve")).alias("x"))
    return top.select(by, F.col("x.curve").alias("curve"), F.col("x.r2").alias("r2"))


def pivoted_sweep(sweep: DataFrame) -> DataFrame:
    """freshness_sweep() with a row a domain and age, and a column a metric."""
    return sweep.groupBy("domain", "avg_age_days").pivot("metric", ["precision_at_5", "ndcg_at_5", "bertscore_f1", "hallucination_rate", "human_eval_score"]).agg(F.max("expected"))


def freshness_sweep(domains: DataFrame, ages: list[int], coefficients: DataFrame, bounds: DataFrame) -> DataFrame:
    """Predictions for each domain(domain, sdi) at each age."""
    grid = domains.select("domain", "sdi", F.explode(F.array(*[F.lit(float(a)) for a in ages])).alias("avg_age_days"))
    grid = grid.withColumn("request_id", F.concat_ws("@", "domain", F.col("avg_age_days").cast("int").cast("string")))
    return predict(grid, coefficients, bounds).join(grid.select("request_id", "domain", "avg_age_days"), "request_id")


#: What a request may ask for.
DOMAINS = sorted(VOLATILITY_SCORE)


def validated(requests: DataFrame) -> DataFrame:
    """requests(request_id, domain, avg_age_days, source_config, sdi), all but the id as text, with typed columns and errors, an array of (field, type, message).

    A missing age is 30 days, a missing configuration 'academic'; a missing diversity is left to its tier. A
    field that does not read as a number, or reads as one that is not finite or below 0, is an error, and so is
    an unknown domain; nothing is raised, so that one bad request is a row. Ages and diversities of bad requests are null.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    number = lambda c: F.expr(f"try_cast(trim(cast({c} AS string)) AS double)")
    error = lambda field, kind, message: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("type"), message.alias("message"))
    domain = F.lower(text("domain"))
    found = [F.when(~domain.isin(DOMAINS), error("domain", "unknown", F.concat(F.lit("Invalid domain '"), text("domain"), F.lit("'. Use technology, healthcare, or history."))))]
    for c in ("avg_age_days", "sdi"):
        v = number(c)
        finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        told = F.concat(F.lit(f"{c} '"), text(c), F.lit("' "))
        found.append(F.when((text(c) != "") & ~finite, error(c, "not a number", F.concat(told, F.lit("is not a number.")))).when((text(c) != "") & (v < 0), error(c, "negative", F.concat(told, F.lit("is negative.")))))
    config = F.coalesce(F.nullif(text("source_config"), F.lit("")), F.lit("academic"))
    rows = requests.withColumn("errors", F.array_compact(F.array(*found)))
    good = F.size("errors") == 0
    return rows.select(
        *[c for c in requests.columns if c not in ("domain", "avg_age_days", "source_config", "sdi")], F.col("domain").alias("asked_domain"), domain.alias("domain"), config.alias("source_config"),
        F.when(good, F.coalesce(number("avg_age_days"), F.lit(30.0))).alias("avg_age_days"), F.when(good, number("sdi")).alias("sdi"), "errors",
    )


def batch_predict(requests: DataFrame, coefficients: DataFrame, bounds: DataFrame, tiers: DataFrame) -> DataFrame:
    """(request_id, domain, avg_age_days, freshness_score, source_config, sdi, source_level, predictions, warnings, errors), a row a request.

    predictions maps a metric to (expected, lower, upper, mae). A request that does not hold has its errors and
    no predictions, and the others of its batch have theirs. A diversity that is not given is that of the
    domain's tier for the configuration. The request's id must name it.
    """
    rows = validated(requests)
    good = resolve_sdi(rows.where(F.size("errors") == 0), tiers)
    done = predict(good, coefficients, bounds).groupBy("request_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", F.struct("expected", "lower", "upper", "mae"))))).alias("predictions"))
    # by a merge, as Spark would take a small file's requests for a table to broadcast
    both = good.join(done.hint("merge"), "request_id", "left").withColumn("warning", warning(F.col("sdi")))
    age = F.col("avg_age_days")
    answered = both.select(
        "request_id", F.col("asked_domain").alias("domain"), F.round(age, 1).alias("avg_age_days"), four(freshness_half_life(age)).alias("freshness_score"), "source_config", F.round("sdi", 3).alias("sdi"), level_name(F.col("tier")).alias("source_level"),
        "predictions", F.array_compact(F.array("warning")).alias("warnings"), "errors",
    )
    refused = rows.where(F.size("errors") > 0).select("request_id", F.col("asked_domain").alias("domain"), *[F.lit(None).cast(answered.schema[c].dataType).alias(c) for c in ("avg_age_days", "freshness_score")], "source_config", *[F.lit(None).cast(answered.schema[c].dataType).alias(c) for c in ("sdi", "source_level", "predictions", "warnings")], "errors")
    return answered.unionByName(refused)
