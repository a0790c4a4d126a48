"""Queries over grouped statistics, models and serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import models, serving, stats, trees
from quarry.operators.order import medians
from quarry.plans.registry import query
from quarry.schema import AS_OF, CELLS_SQL, VOLATILITY_SCORE, cells, table

SS_SQL = CELLS_SQL + """, g AS (SELECT metric, sum(n * mean) / sum(n) AS g, sum(n) AS nn FROM cells GROUP BY metric),
sst AS (SELECT metric, sum((n - 1) * std * std + n * pow(mean - g, 2)) AS sst FROM cells JOIN g USING (metric) GROUP BY metric),
grp AS (SELECT metric, level, sum(n) AS n, sum(n * mean) / sum(n) AS m, sum((n - 1) * std * std + n * mean * mean) AS q FROM cells GROUP BY ALL),
ssb AS (SELECT metric, count(*) AS k, sum(n * pow(m - g, 2)) AS ssb FROM grp JOIN g USING (metric) GROUP BY metric),
ow AS (SELECT metric, k, nn::BIGINT AS n, round(ssb / (k - 1) / ((sst - ssb) / (nn - k)), 6) AS f, ssb / sst AS eta FROM ssb JOIN sst USING (metric) JOIN g USING (metric))"""
EFFECT = "CASE WHEN eta >= 0.14 THEN 'large' WHEN eta >= 0.06 THEN 'medium' WHEN eta >= 0.01 THEN 'small' ELSE 'negligible' END"


@query("q125_one_way_anova", f"WITH {SS_SQL} SELECT metric, k, n, f, round(eta, 6) AS eta_squared, {EFFECT} AS effect FROM ow")
def q125(spark, d):
    """One-way F on sufficient statistics, effect size #58, #183."""
    return stats.one_way(cells(spark, d), ["metric"], "level")


@query("q125_anova_p", None)
def q125p(spark, d):
    return stats.with_p(stats.one_way(cells(spark, d), ["metric"], "level"), ["metric"])


@query("q131_stratified_anova", f"WITH {CELLS_SQL}, g AS (SELECT metric, volatility, sum(n * mean) / sum(n) AS g, sum(n) AS nn, count(*) AS k FROM cells GROUP BY ALL), s AS (SELECT metric, volatility, k, nn, sum(n * pow(mean - g, 2)) AS ssb, sum((n - 1) * std * std) AS ssw FROM cells JOIN g USING (metric, volatility) GROUP BY ALL), e AS (SELECT *, ssb / (ssb + ssw) AS eta FROM s) SELECT metric, volatility, k, nn::BIGINT AS n, round(ssb / (k - 1) / (ssw / (nn - k)), 6) AS f, round(eta, 6) AS eta_squared, {EFFECT} AS effect FROM e")
def q131(spark, d):
    return stats.one_way(cells(spark, d), ["metric", "volatility"], "level")


@query("q126_pairwise", f"WITH {SS_SQL}, s AS (SELECT metric, level, n, m, sqrt(greatest(0, (q - n * m * m) / (n - 1))) AS s FROM grp), p AS (SELECT a.metric, a.level AS group1, b.level AS group2, b.m - a.m AS md, (a.m - b.m) / sqrt(((a.n - 1) * a.s * a.s + (b.n - 1) * b.s * b.s) / (a.n + b.n - 2)) AS d FROM s a JOIN s b ON a.metric = b.metric AND a.level < b.level) SELECT metric, group1, group2, round(md, 6) AS mean_diff, round(d, 6) AS cohens_d, CASE WHEN abs(d) >= 0.8 THEN 'large' WHEN abs(d) >= 0.5 THEN 'medium' WHEN abs(d) >= 0.2 THEN 'small' ELSE 'negligible' END AS effect FROM p")
def q126(spark, d):
    return stats.pairwise(cells(spark, d), ["metric"], "level")


@query("q128_two_way_main", f"WITH {CELLS_SQL}, e AS (SELECT metric, sum(n) AS nn, count(*) AS c, sum((n - 1) * std * std) AS sse FROM cells GROUP BY metric), r AS (SELECT * FROM cells WHERE volatility = 'low'), g AS (SELECT metric, sum(n * mean) / sum(n) AS g FROM r GROUP BY metric), b AS (SELECT metric, count(*) AS k, sum(n * pow(mean - g, 2)) AS ssb FROM r JOIN g USING (metric) GROUP BY metric) SELECT metric, round(ssb / (k - 1) / (sse / (nn - c)), 6) AS f FROM b JOIN e USING (metric)")
def q128(spark, d):
    return stats.two_way_main(cells(spark, d), ["metric"], "level", "volatility", "low")


@query("q127_two_way", None)
def q127(spark, d):
    return stats.two_way(cells(spark, d), "metric", "level", "volatility")


@query("q129_fallback", f"WITH a AS (WITH {SS_SQL.replace('FROM events', "FROM events WHERE event_id % 3 = 0")} SELECT metric, k, n, f FROM ow) SELECT metric, 'level' AS factor, k, n, f FROM a")
def q129(spark, d):
    """Two one-way tests where a two-way one can't be made, as a factor has one level; that factor has no row."""
    return stats.one_way_fallback(cells(spark, d).where("volatility = 'low'"), ["metric"], ["level", "volatility"]).select("metric", "factor", "k", "n", "f")


@query("q130_tukey_distances", f"""WITH {CELLS_SQL}, g AS (SELECT metric, level, sum(n)::DOUBLE AS n, sum(n * mean) / sum(n) AS m, sum((n - 1) * std * std + n * mean * mean) AS q FROM cells GROUP BY ALL),
v AS (SELECT *, greatest(0, (q - n * m * m) / (n - 1)) AS var, sum(n) OVER w - count(*) OVER w AS df, count(*) OVER w AS k FROM g WINDOW w AS (PARTITION BY metric)),
e AS (SELECT *, sum((n - 1) * var) OVER (PARTITION BY metric) / df AS mse FROM v)
SELECT a.metric, a.level::VARCHAR AS group1, b.level::VARCHAR AS group2, round(b.m - a.m, 4) AS mean_diff, round(abs(b.m - a.m) / sqrt(a.mse / 2 * (1 / a.n + 1 / b.n)), 4) AS q,
  round((a.m - b.m) / sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2)), 4) AS cohens_d, round(0.05 / (a.k * (a.k - 1) / 2), 6) AS bonferroni_alpha FROM e a JOIN e b ON a.metric = b.metric AND a.level < b.level""")
def q130_distances(spark, d):
    """What SQL can say of the comparisons; p and the interval are held against published tables in tests."""
    return stats.tukey(cells(spark, d), "metric", "level").select("metric", "group1", "group2", "mean_diff", "q", "cohens_d", "bonferroni_alpha")


@query("q130_tukey", None)
def q130(spark, d):
    return stats.tukey(cells(spark, d), "metric", "level")


@query("q132_levene", "WITH m AS (SELECT event_type, user_id % 3 AS g, median(value) AS med FROM events GROUP BY ALL), z AS (SELECT e.event_type, e.user_id % 3 AS g, abs(e.value - m.med) AS d FROM events e JOIN m ON e.event_type = m.event_type AND e.user_id % 3 = m.g), c AS (SELECT event_type, g, count(d) AS n, avg(d) AS m, stddev_samp(d) AS s FROM z GROUP BY ALL), t AS (SELECT event_type, sum(n * m) / sum(n) AS gm FROM c GROUP BY 1) SELECT c.event_type, count(*) AS k, sum(n)::BIGINT AS n, round(sum(n * pow(m - gm, 2)) / (count(*) - 1) / (sum((n - 1) * s * s) / (sum(n) - count(*))), 6) AS f FROM c JOIN t ON c.event_type = t.event_type GROUP BY c.event_type")
def q132(spark, d):
    e = table(spark, d, "events").withColumn("g", F.col("user_id") % 3)
    return stats.levene(e, ["event_type"], "g", "value")


@query("q132_shapiro_wilk", None)
def q132_shapiro(spark, d):
    """Normality of all values of each type; tests hold W and p against published examples."""
    return stats.shapiro_wilk(table(spark, d, "events"), ["event_type"], "value")


@query("q132_medians", "SELECT event_type, user_id % 3 AS g, count(value) AS n, median(value) AS median FROM events GROUP BY ALL")
def q132_medians(spark, d):
    """Medians as order statistics by rank, without a group in one task."""
    return medians(table(spark, d, "events").withColumn("g", F.col("user_id") % 3), ["event_type", "g"], "value")


@query("q133_descriptive", f"WITH {SS_SQL} SELECT metric, level, n::BIGINT AS n, round(m, 6) AS mean, round(sqrt(greatest(0, (q - n * m * m) / (n - 1))), 6) AS std FROM grp")
def q133(spark, d):
    return stats.group_stats(cells(spark, d), ["metric"], "level").select("metric", "level", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("q134_marginal_gains", f"WITH {SS_SQL}, p AS (SELECT metric, max(m) FILTER (level = 1) AS a, max(m) FILTER (level = 2) AS b, max(m) FILTER (level = 3) AS c FROM grp GROUP BY metric) SELECT metric, round(b - a, 6) AS gain_12, round(c - b, 6) AS gain_23, round(c - a, 6) AS total, round(100 * (b - a) / (c - a), 2) AS share_12, round(100 * (c - b) / (c - a), 2) AS share_23, CASE WHEN abs(c - b) > abs(b - a) THEN 'technical' ELSE 'news' END AS dominant FROM p")
def q134(spark, d):
    return stats.marginal_gains(stats.group_stats(cells(spark, d), ["metric"], "level"), ["metric"])


@query("q135_rankings", f"WITH {SS_SQL} SELECT metric, level, (row_number() OVER (PARTITION BY metric ORDER BY m DESC, level))::INT AS place FROM grp")
def q135(spark, d):
    from pyspark.sql import Window

    g = stats.group_stats(cells(spark, d), ["metric"], "level")
    return g.select("metric", "level", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("mean"), "level")).alias("place"))


@query("q136_correlation", "SELECT round(corr(l_quantity, l_extendedprice), 4) AS a, round(corr(l_discount, l_tax), 4) AS b, round(corr(l_quantity, l_discount), 4) AS c FROM lineitem")
def q136(spark, d):
    c = lambda x, y: F.round(F.corr(x, y), 4)
    return table(spark, d, "lineitem").agg(c("l_quantity", "l_extendedprice").alias("a"), c("l_discount", "l_tax").alias("b"), c("l_quantity", "l_discount").alias("c"))


@query("q137_pivot", f"WITH {CELLS_SQL} SELECT volatility, round(avg(mean) FILTER (level = 1), 6) AS l1, round(avg(mean) FILTER (level = 2), 6) AS l2, round(avg(mean) FILTER (level = 3), 6) AS l3 FROM cells GROUP BY volatility")
def q137(spark, d):
    p = cells(spark, d).groupBy("volatility").pivot("level", [1, 2, 3]).agg(F.avg("mean"))
    return p.select("volatility", *[F.round(str(i), 6).alias(f"l{i}") for i in (1, 2, 3)])


@query("q026_chart_frames", "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean, count(*) AS n FROM lineitem GROUP BY ALL")
def q026(spark, d):
    """Frames behind charts: group means and counts."""
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.count("*").alias("n"))


def _model_rows(spark, d):
    """Line items as model rows: three factors and a target."""
    i = table(spark, d, "lineitem")
    rows = i.select((F.col("l_quantity") / 50).alias("freshness_score"), (F.col("l_discount") * 10).alias("source_diversity_index"), F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 0.5).otherwise(0.0).alias("domain_volatility"), (F.col("l_extendedprice") / 100000).alias("y"), "l_returnflag", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"))
    return models.features(rows)


@query("q142_features", "SELECT round(sum(f * s), 3) AS fs, round(sum(f * v), 3) AS fv, round(sum(s * v), 3) AS sv, count(*) AS n FROM (SELECT l_quantity / 50 AS f, l_discount * 10 AS s, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.5 ELSE 0.0 END::DOUBLE AS v FROM lineitem)")
def q142(spark, d):
    return _model_rows(spark, d).agg(F.round(F.sum("fresh_x_diversity"), 3).alias("fs"), F.round(F.sum("fresh_x_volatility"), 3).alias("fv"), F.round(F.sum("source_x_volatility"), 3).alias("sv"), F.count("*").alias("n"))


def _ols_sql(rows: str, x: str, y: str) -> str:
    """Simple regression in closed form, as ols() gives it for one feature."""
    return f"""WITH r AS ({rows}), m AS (SELECT count(*) AS n, avg({x}) AS mx, avg({y}) AS my, sum({x} * {x}) AS xx, regr_slope({y}, {x}) AS b, regr_intercept({y}, {x}) AS a, regr_r2({y}, {x}) AS r2, regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy FROM r),
v AS (SELECT *, syy * (1 - r2) / (n - 2) AS s2 FROM m), c AS (SELECT 'intercept' AS feature, a AS coef, sqrt(s2 * xx / (n * sxx)) AS se, * FROM v UNION ALL SELECT '{x}', b, sqrt(s2 / sxx), * FROM v)
SELECT feature, round(coef, 6) AS coef, round(se, 6) AS std_err, round(coef / se, 4) AS t, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adj_r2, round(r2 / ((1 - r2) / (n - 2)), 2) AS f, n FROM c"""


@query("q144_ols", _ols_sql("SELECT l_quantity / 50 AS freshness_score, l_extendedprice / 100000 AS y FROM lineitem", "freshness_score", "y"))
def q144(spark, d):
    """Coefficients, errors, t, R2 and F; with one feature, as SQL has them in closed form. Tests hold p and several features against numpy."""
    found = models.ols(_model_rows(spark, d), "y", models.BASE[:1])
    return found.select("feature", "coef", "std_err", F.round("t", 4).alias("t"), "r2", "adj_r2", F.round("f", 2).alias("f"), "n")


@query("q144_ols_all", None)
def q144_all(spark, d):
    return models.ols(_model_rows(spark, d), "y", models.BASE)


@query("q145_moderated", None)
def q145_moderated(spark, d):
    """Diversity moderated by volatility."""
    return models.moderated(_model_rows(spark, d), "y", "source_diversity_index", "domain_volatility")


@query("q145_simple_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem GROUP BY 1")
def q145(spark, d):
    return models.simple_regression(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")


@query("q146_ols_cv", None)
def q146(spark, d):
    return models.ols_cv(_model_rows(spark, d), "y", models.BASE, "key")


def _importances_and_bounds(found):
    """One table of both: a row a feature, with the errors beside it."""
    weight, bounds = found
    return weight.withColumns({k: F.lit(v) for k, v in bounds.first().asDict().items()})


@query("q147_small_forest", None)
def q147(spark, d):
    """The condition-level forest: its grid by R2 in three folds, then ten."""
    return _importances_and_bounds(trees.forest_search(_model_rows(spark, d), "y", models.BASE, "key", trees.SMALL_GRID, 500, 3, 10, "r2"))


@query("q148_forest", None)
def q148(spark, d):
    """The query-level forest: 500 trees, its grid of twelve in five folds, then ten folds."""
    return _importances_and_bounds(trees.forest_search(_model_rows(spark, d), "y", models.BASE, "key"))


@query("q149_boosted", None)
def q149(spark, d):
    """300 rounds in each of ten folds."""
    return _importances_and_bounds(trees.boosted_search(_model_rows(spark, d), "y", models.BASE, "key"))


@query("q150_decay", None)
def q150(spark, d):
    o = table(spark, d, "orders")
    age = F.datediff(F.lit(AS_OF).cast("date"), F.col("o_orderdate").cast("date"))
    return models.decay_fits(o.select("o_orderpriority", (F.exp(-age / 2000.0)).alias("x"), (F.col("o_totalprice") / 1e5).alias("y")), "o_orderpriority", "x", "y")


@query("q150_quadratic", """WITH r AS (SELECT o_orderpriority AS g, exp(-date_diff('day', o_orderdate::DATE, DATE '2024-01-31') / 2000.0::DOUBLE) AS x, o_totalprice / 1e5::DOUBLE AS y FROM orders),
e AS (SELECT *, min(x) OVER (PARTITION BY g) AS lo, max(x) OVER (PARTITION BY g) - min(x) OVER (PARTITION BY g) AS sp FROM r), t AS (SELECT g, lo, sp, (x - lo) / sp AS u, y FROM e),
s AS (SELECT g, any_value(lo) AS lo, any_value(sp) AS sp, count(*)::DOUBLE AS n, sum(u) AS a, sum(u * u) AS b, sum(pow(u, 3)) AS c, sum(pow(u, 4)) AS d, sum(y) AS p, sum(u * y) AS q, sum(u * u * y) AS w, sum(y * y) AS yy FROM t GROUP BY g),
k AS (SELECT *, d * (b * n - a * a) - c * (c * n - a * b) + b * (c * a - b * b) AS det FROM s),
v AS (SELECT *, (w * (b * n - a * a) - c * (q * n - a * p) + b * (q * a - b * p)) / det AS c2, (d * (q * n - p * a) - w * (c * n - a * b) + b * (c * p - q * b)) / det AS c1, (d * (b * p - a * q) - c * (c * p - b * q) + w * (c * a - b * b)) / det AS c0 FROM k)
SELECT g AS o_orderpriority, round((c2 / (sp * sp))::DECIMAL(38,12), 3)::DOUBLE AS a, round((c1 / sp - 2 * c2 * lo / (sp * sp))::DECIMAL(38,12), 3)::DOUBLE AS b, round((c0 - c1 * lo / sp + c2 * lo * lo / (sp * sp))::DECIMAL(38,12), 3)::DOUBLE AS c,
  round((1 - (yy - c2 * w - c1 * q - c0 * p) / (yy - p * p / n))::DECIMAL(38,12), 5)::DOUBLE AS r2 FROM v""")
def q150_quadratic(spark, d):
    """The curve that SQL has in closed form; the other two are held against known curves in tests."""
    at = lambda i: F.round(F.get("params", F.lit(i)).cast("decimal(38,12)"), 3).cast("double")
    return q150(spark, d).where("curve = 'polynomial'").select("o_orderpriority", at(0).alias("a"), at(1).alias("b"), at(2).alias("c"), F.round(F.col("r2").cast("decimal(38,12)"), 5).cast("double").alias("r2"))


@query("q151_held_out_groups", None)
def q151(spark, d):
    return trees.held_out_groups(_model_rows(spark, d), "y", models.BASE, "l_returnflag")


@query("q152_t_interval", "SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 6) AS mean, round(avg(o_totalprice) - 1.96 * stddev_samp(o_totalprice) / sqrt(count(o_totalprice)), 6) AS low, round(avg(o_totalprice) + 1.96 * stddev_samp(o_totalprice) / sqrt(count(o_totalprice)), 6) AS high FROM orders GROUP BY 1")
def q152(spark, d):
    return stats.t_interval(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", 1.96)


COEF = [("precision_at_5", "intercept", 0.14), ("precision_at_5", "freshness_score", 0.39), ("precision_at_5", "source_diversity_index", -0.17), ("precision_at_5", "fresh_x_volatility", -0.11), ("hallucination_rate", "intercept", 0.39), ("hallucination_rate", "source_x_volatility", 0.2), ("bertscore_f1", "intercept", 0.8), ("ndcg_at_5", "intercept", 0.5), ("ndcg_at_5", "fresh_x_diversity", 0.3), ("human_eval_score", "intercept", 3.2)]
MAE = [("precision_at_5", 0.2224), ("hallucination_rate", 0.4837), ("bertscore_f1", 0.1186), ("ndcg_at_5", 0.31), ("human_eval_score", 0.3)]
VOL = "CASE domain " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in VOLATILITY_SCORE.items()) + " ELSE 0.5 END::DOUBLE"
REQ_SQL = """req AS (SELECT o_orderkey AS request_id, ['technology', 'healthcare', 'history'][(o_orderkey % 3 + 1)::INT] AS domain, (o_custkey % 400)::DOUBLE AS age, (o_orderkey % 60) / 100.0::DOUBLE AS s FROM orders)"""
#: Predictions for req(request_id, domain, age, s).
PRED_SQL = f"""ft AS (SELECT *, {VOL} AS v, exp(-ln(2) * age / 180.0) AS f FROM req),
x AS (SELECT request_id, s, v, unnest([{{'n': 'intercept', 'x': 1.0::DOUBLE}}, {{'n': 'freshness_score', 'x': f}}, {{'n': 'source_diversity_index', 'x': s}}, {{'n': 'domain_volatility', 'x': v}}, {{'n': 'fresh_x_diversity', 'x': f * s}}, {{'n': 'fresh_x_volatility', 'x': f * v}}, {{'n': 'source_x_volatility', 'x': s * v}}]) AS u FROM ft),
coef(metric, feature, coef) AS (VALUES {', '.join(map(str, COEF))}), mae(metric, mae) AS (VALUES {', '.join(map(str, MAE))}),
raw AS (SELECT request_id, metric, round(sum(coef::DOUBLE * u.x), 9) AS raw FROM x JOIN coef ON u.n = feature GROUP BY ALL),
lim AS (SELECT *, CASE WHEN metric = 'human_eval_score' THEN 1.0 ELSE 0.0 END::DOUBLE AS lo, CASE WHEN metric = 'human_eval_score' THEN 5.0 ELSE 1.0 END::DOUBLE AS hi FROM raw JOIN mae USING (metric)),
pred AS (SELECT *, greatest(lo, least(hi, raw)) AS p FROM lim)"""
REQUESTS_SQL = REQ_SQL + ",\n" + PRED_SQL


def _requests(spark, d):
    o = table(spark, d, "orders")
    n = F.col("o_orderkey")
    dom = F.when(n % 3 == 0, "technology").when(n % 3 == 1, "healthcare").otherwise("history")
    cfg = F.when(n % 4 == 0, "full").when(n % 4 == 1, "academic+news").otherwise("academic")
    return o.select(n.alias("request_id"), dom.alias("domain"), (F.col("o_custkey") % 400).cast("double").alias("avg_age_days"), ((n % 60) / 100).cast("double").alias("sdi"), cfg.alias("source_config"))


def _tables(spark):
    return spark.createDataFrame(COEF, "metric string, feature string, coef double"), spark.createDataFrame(MAE, "metric string, mae double")


@query("q153_predict", f"WITH {REQUESTS_SQL} SELECT request_id, metric, round((p)::DECIMAL(20,9), 4)::DOUBLE AS expected, round((greatest(lo, least(hi, p - mae)))::DECIMAL(20,9), 4)::DOUBLE AS lower, round((greatest(lo, least(hi, p + mae)))::DECIMAL(20,9), 4)::DOUBLE AS upper, round(mae::DOUBLE, 4) AS mae FROM pred")
def q153(spark, d):
    """Predictions with bands #153, batches #154, #164, feature sets #186."""
    return serving.predict(_requests(spark, d), *_tables(spark))


@query("q160_readiness", f"WITH {REQUESTS_SQL}, w(metric, w) AS (VALUES ('precision_at_5', 0.35::DOUBLE), ('bertscore_f1', 0.30::DOUBLE), ('hallucination_rate', 0.20::DOUBLE), ('ndcg_at_5', 0.15::DOUBLE)) SELECT request_id, round_even(round(100 * sum(w * CASE WHEN metric = 'hallucination_rate' THEN 1 - round((p)::DECIMAL(20,9), 4)::DOUBLE ELSE round((p)::DECIMAL(20,9), 4)::DOUBLE END) / sum(w), 9), 0)::INT AS readiness FROM pred JOIN w USING (metric) GROUP BY request_id")
def q160(spark, d):
    return serving.readiness(serving.predict(_requests(spark, d), *_tables(spark)))


def _metrics(spark, d):
    """Conditions with a diversity index and a metric, from suppliers by nation."""
    s = table(spark, d, "supplier")
    n = F.col("s_nationkey")
    dom = F.when(n % 3 == 0, "technology").when(n % 3 == 1, "healthcare").otherwise("history")
    return s.select(dom.alias("domain"), ((n % 4) * 0.11).cast("double").alias("sdi"), (F.col("s_acctbal") / 10000).alias("precision_at_5"))


METRICS_SQL = "met AS (SELECT ['technology', 'healthcare', 'history'][(s_nationkey % 3 + 1)::INT] AS domain, (s_nationkey % 4) * 0.11::DOUBLE AS sdi, s_acctbal / 10000 AS precision_at_5 FROM supplier), tiers AS (SELECT domain, tier, round(avg(sdi), 4) AS tier_sdi, count(*) AS n_conditions, round(avg(precision_at_5), 4) AS precision_at_5 FROM (SELECT *, (dense_rank() OVER (PARTITION BY domain ORDER BY round(sdi, 4)) - 1)::INT AS tier FROM met) GROUP BY domain, tier)"


@query("q156_source_tiers", f"WITH {METRICS_SQL} SELECT * FROM tiers")
def q156(spark, d):
    return serving.source_tiers(_metrics(spark, d), ["precision_at_5"])


@query("q157_tier_summary", f"WITH {METRICS_SQL}, b AS (SELECT domain, arg_max(tier, (precision_at_5, -tier)) AS bt, max(precision_at_5) AS b, arg_min(tier, (precision_at_5, tier)) AS wt, min(precision_at_5) AS w, arg_max(precision_at_5, tier) AS tp, max(tier) AS t FROM tiers GROUP BY domain) SELECT domain, bt AS best_tier, b AS best, wt AS worst_tier, w AS worst, CASE WHEN w > 0 THEN round(100 * (b - w) / w, 1) END AS delta_pct, EXISTS (SELECT 1 FROM tiers x WHERE x.domain = b.domain AND x.tier < b.t AND x.precision_at_5 > b.tp) AS pollution FROM b")
def q157(spark, d):
    return serving.tier_summary(serving.source_tiers(_metrics(spark, d), ["precision_at_5"]), "precision_at_5")


@query("q155_resolve_sdi", f"WITH {METRICS_SQL}, r AS (SELECT o_orderkey AS request_id, ['technology', 'healthcare', 'history'][(o_orderkey % 3 + 1)::INT] AS domain, CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS want FROM orders), m AS (SELECT domain, max(tier) AS most FROM tiers GROUP BY domain) SELECT request_id, least(want, most)::INT AS tier, tier_sdi AS sdi FROM r JOIN m USING (domain) JOIN tiers USING (domain) WHERE tier = least(want, most)")
def q155(spark, d):
    tiers = serving.source_tiers(_metrics(spark, d), ["precision_at_5"])
    return serving.resolve_sdi(_requests(spark, d).drop("sdi"), tiers).select("request_id", "tier", "sdi")


@query("q159_cadence", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Weekly' WHEN 1 THEN 'Monthly' ELSE 'Quarterly' END AS cadence FROM orders")
def q159(spark, d):
    from quarry.schema import lookup

    return _requests(spark, d).select(F.col("request_id").alias("o_orderkey"), serving.cadence(lookup(VOLATILITY_SCORE, F.col("domain"), 0.5)).alias("cadence"))


SUMMARY_SQL = """sm AS (SELECT domain, arg_max(tier, (precision_at_5, -tier)) AS bt, max(precision_at_5) AS b, arg_min(tier, (precision_at_5, tier)) AS wt, min(precision_at_5) AS w, arg_max(precision_at_5, tier) AS tp, max(tier) AS t FROM tiers GROUP BY domain),
summ AS (SELECT *, CASE WHEN w > 0 THEN round(100 * (b - w) / w, 1) END AS delta, EXISTS (SELECT 1 FROM tiers x WHERE x.domain = sm.domain AND x.tier < sm.t AND x.precision_at_5 > sm.tp) AS pollution FROM sm)"""
EXPECTED_SQL = "exp AS (SELECT request_id, metric, round(p::DECIMAL(20,9), 4)::DOUBLE AS e, round((greatest(lo, least(hi, p - mae)))::DECIMAL(20,9), 4)::DOUBLE AS l, round((greatest(lo, least(hi, p + mae)))::DECIMAL(20,9), 4)::DOUBLE AS u FROM pred)"
READY_SQL = "wt(metric, wt) AS (VALUES ('precision_at_5', 0.35::DOUBLE), ('bertscore_f1', 0.30::DOUBLE), ('hallucination_rate', 0.20::DOUBLE), ('ndcg_at_5', 0.15::DOUBLE)), ready AS (SELECT request_id, round_even(round(100 * sum(wt * CASE WHEN metric = 'hallucination_rate' THEN 1 - e ELSE e END) / sum(wt), 9), 0)::INT AS readiness FROM exp JOIN wt USING (metric) GROUP BY request_id)"
CADENCE_SQL = "CASE domain WHEN 'technology' THEN 'Weekly' WHEN 'healthcare' THEN 'Monthly' ELSE 'Quarterly' END"
LEVEL_SQL = "CASE {0} WHEN 0 THEN 'Single-Source' WHEN 1 THEN 'Two-Source Mix' ELSE 'Full Diversity' END"


TIERS_SQL = METRICS_SQL.replace("tiers AS (", "tiers AS MATERIALIZED (")
#: SUMMARY_SQL with an aggregate instead of a query for each row.
SUMMARY_ONCE_SQL = """sm AS MATERIALIZED (SELECT domain, arg_max(tier, (precision_at_5, -tier)) AS bt, max(precision_at_5) AS b, arg_min(tier, (precision_at_5, tier)) AS wt, min(precision_at_5) AS w, arg_max(precision_at_5, tier) AS tp, max(tier) AS t FROM tiers GROUP BY domain),
lean AS MATERIALIZED (SELECT tiers.domain, bool_or(tier < t AND precision_at_5 > tp) AS pollution FROM tiers JOIN sm ON tiers.domain = sm.domain GROUP BY tiers.domain),
summ AS MATERIALIZED (SELECT sm.*, CASE WHEN w > 0 THEN round(100 * (b - w) / w, 1) END AS delta, pollution FROM sm JOIN lean USING (domain))"""


@query("q161_recommendations", f"""WITH {TIERS_SQL}, {SUMMARY_ONCE_SQL}, top AS (SELECT domain, max(tier) AS most FROM tiers GROUP BY domain),
ask AS (SELECT o_orderkey AS request_id, ['technology', 'healthcare', 'history'][(o_orderkey % 3 + 1)::INT] AS domain, (o_custkey % 400)::DOUBLE AS age, o_orderkey % 4 = 0 AS whole, CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS want FROM orders),
req AS MATERIALIZED (SELECT a.request_id, a.domain, a.age, a.whole, t.tier, t.tier_sdi AS s, t.precision_at_5 AS own FROM ask a JOIN top USING (domain) JOIN tiers t ON t.domain = a.domain AND t.tier = least(want, most)),
{PRED_SQL.replace('raw AS (', 'raw AS MATERIALIZED (')}, {EXPECTED_SQL.replace('exp AS (', 'exp AS MATERIALIZED (')}, {READY_SQL.replace('ready AS (', 'ready AS MATERIALIZED (')},
told AS (SELECT req.*, bt, b, wt AS worst_tier, w, delta, coalesce(own < b, false) AS under, coalesce(pollution AND whole, false) AS polluted, CASE WHEN s > 0.45 THEN 'Source diversity index ' || printf('%.2f', s) || ' lies beyond the training range.' END AS warning FROM req JOIN summ USING (domain)),
risky AS (SELECT *, list_filter([CASE WHEN polluted THEN '{serving.POLLUTION}' END, CASE WHEN under THEN '{serving.UNDERPERFORMS[0]}' || {LEVEL_SQL.format('bt')} || '{serving.UNDERPERFORMS[1]}' END, warning], lambda x: x IS NOT NULL) AS r FROM told)
SELECT request_id, {CADENCE_SQL} AS cadence, readiness, bt AS best_tier, tier::INT AS tier, under AS underperforms, polluted AS pollution_risk, warning,
  printf('Expected Precision@5: %s (95%% band %s-%s)', round(e::DECIMAL(20,9), 3)::DECIMAL(20,3)::VARCHAR, round(l::DECIMAL(20,9), 3)::DECIMAL(20,3)::VARCHAR, round(u::DECIMAL(20,9), 3)::DECIMAL(20,3)::VARCHAR) AS performance_range, CASE WHEN len(r) > 0 THEN r ELSE ['{serving.NO_RISK}'] END AS risks,
  CASE WHEN delta IS NULL THEN '' ELSE printf('Source mix matters here: moving from %s (%s) to %s (%s) changes Precision@5 by %+.1f%%.', {LEVEL_SQL.format('worst_tier')}, round(w::DECIMAL(20,9), 3)::DECIMAL(20,3)::VARCHAR, {LEVEL_SQL.format('bt')}, round(b::DECIMAL(20,9), 3)::DECIMAL(20,3)::VARCHAR, delta) END AS key_finding
FROM risky JOIN ready USING (request_id) JOIN exp USING (request_id) WHERE metric = 'precision_at_5'""")
def q161(spark, d):
    """Recommendations #161."""
    tiers = serving.source_tiers(_metrics(spark, d), ["precision_at_5"])
    asked = serving.resolve_sdi(_requests(spark, d).drop("sdi"), tiers)
    return serving.recommendations(asked, serving.predict(asked, *_tables(spark)), tiers)


ASKED_SQL = """asked AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 11 = 0 THEN 'sports' ELSE [' Technology', 'healthcare', 'history'][(o_orderkey % 3 + 1)::INT] END AS d,
  CASE WHEN o_custkey % 13 = 1 THEN '-3' WHEN o_custkey % 13 = 2 THEN 'old' WHEN o_custkey % 13 = 3 THEN NULL ELSE (o_custkey % 400)::VARCHAR END AS a, CASE WHEN o_orderkey % 17 = 4 THEN 'x' WHEN o_orderkey % 5 = 0 THEN '' ELSE ((o_orderkey % 60) / 100.0::DOUBLE)::VARCHAR END AS sd FROM orders),
told AS (SELECT *, lower(trim(d)) AS domain, concat_ws(',', CASE WHEN lower(trim(d)) NOT IN ('technology', 'healthcare', 'history') THEN 'domain:unknown' END, CASE a WHEN '-3' THEN 'avg_age_days:negative' WHEN 'old' THEN 'avg_age_days:not a number' END, CASE sd WHEN 'x' THEN 'sdi:not a number' END) AS errors FROM asked)"""


@query("q154_batch_predict", f"""WITH {TIERS_SQL}, {ASKED_SQL}, req AS MATERIALIZED (SELECT request_id, told.domain, coalesce(try_cast(a AS DOUBLE), 30.0) AS age, coalesce(try_cast(nullif(sd, '') AS DOUBLE), tier_sdi, 0.0) AS s FROM told LEFT JOIN tiers ON tiers.domain = told.domain AND tier = 0 WHERE errors = ''),
{PRED_SQL.replace('raw AS (', 'raw AS MATERIALIZED (')}, {EXPECTED_SQL}, one AS (SELECT request_id, max(e) FILTER (metric = 'precision_at_5') AS p, max(l) FILTER (metric = 'hallucination_rate') AS h, count(*) AS n FROM exp GROUP BY request_id)
SELECT t.request_id, t.d AS domain, t.errors, p AS precision_at_5, h AS hallucination_low, n AS n_metrics, CASE WHEN req.request_id IS NOT NULL THEN CASE WHEN req.s > 0.45 THEN 1 ELSE 0 END END::INT AS n_warnings FROM told t LEFT JOIN one USING (request_id) LEFT JOIN req USING (request_id)""")
def q154(spark, d):
    """Requests as text, some of them bad: each has its predictions or its errors."""
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    asked = table(spark, d, "orders").select(
        n.alias("request_id"), F.when(n % 11 == 0, "sports").when(n % 3 == 0, " Technology").when(n % 3 == 1, "healthcare").otherwise("history").alias("domain"),
        F.when(c % 13 == 1, "-3").when(c % 13 == 2, "old").when(c % 13 != 3, (c % 400).cast("string")).alias("avg_age_days"), F.lit("academic").alias("source_config"),
        F.when(n % 17 == 4, "x").when(n % 5 == 0, "").otherwise(((n % 60) / 100).cast("string")).alias("sdi"),
    )
    done = serving.batch_predict(asked, *_tables(spark), serving.source_tiers(_metrics(spark, d), ["precision_at_5"]))
    errors = F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["field"], e["type"])), ",")
    p = lambda m, x: F.try_element_at("predictions", F.lit(m))[x]
    return done.select("request_id", "domain", errors.alias("errors"), p("precision_at_5", "expected").alias("precision_at_5"), p("hallucination_rate", "lower").alias("hallucination_low"), F.map_keys("predictions").alias("k"), F.size("warnings").alias("w")).select(
        "request_id", "domain", "errors", "precision_at_5", "hallucination_low", F.when(F.col("k").isNotNull(), F.size("k").cast("long")).alias("n_metrics"), F.when(F.col("k").isNotNull(), F.col("w")).alias("n_warnings")
    )


DOMAINS_SQL = "dom AS (SELECT domain, round(avg(sdi)::DECIMAL(38,12), 4)::DOUBLE AS s FROM met GROUP BY domain)"
SWEEP_SQL = "req AS (SELECT domain || '@' || age AS request_id, domain, age::DOUBLE AS age, s FROM {0}, (SELECT unnest({1}) AS age))"


@query("q158_sensitivity", f"WITH {METRICS_SQL}, {DOMAINS_SQL}, {SWEEP_SQL.format('dom', [3, 365])}, {PRED_SQL}, {EXPECTED_SQL} SELECT domain, round(abs(max(e) FILTER (age = 3) - max(e) FILTER (age = 365)), 4) AS sensitivity FROM exp JOIN req USING (request_id) WHERE metric = 'precision_at_5' GROUP BY domain")
def q158(spark, d):
    return serving.sensitivity(_domains(spark, d), *_tables(spark))


def _domains(spark, d):
    """The domains that suppliers have, with their mean diversity."""
    return _metrics(spark, d).groupBy("domain").agg(F.round(F.avg("sdi").cast("decimal(38,12)"), 4).cast("double").alias("sdi"))


@query("q181_guidelines", f"WITH {METRICS_SQL}, {SUMMARY_SQL}, dom AS (SELECT domain, tier_sdi AS s, bt, pollution FROM summ JOIN tiers USING (domain) WHERE tier = bt), {SWEEP_SQL.format('dom', [3, 90, 365])}, {PRED_SQL}, {EXPECTED_SQL}, g AS (SELECT domain, round(abs(max(e) FILTER (age = 3 AND metric = 'precision_at_5') - max(e) FILTER (age = 365 AND metric = 'precision_at_5')), 4) AS sensitivity, max(e) FILTER (age = 90 AND metric = 'precision_at_5') AS precision_at_5, max(e) FILTER (age = 90 AND metric = 'hallucination_rate') AS hallucination_rate, max(e) FILTER (age = 90 AND metric = 'bertscore_f1') AS bertscore_f1 FROM exp JOIN req USING (request_id) GROUP BY domain), bd(domain, n) AS (VALUES ('technology', 2), ('healthcare', 0)) SELECT domain, {VOL} AS volatility, {CADENCE_SQL} AS cadence, sensitivity, {LEVEL_SQL.format('bt')} AS best_source_level, pollution, precision_at_5, hallucination_rate, bertscore_f1, n AS boundary_conditions, n = 0 AS reliable FROM g JOIN dom USING (domain) LEFT JOIN bd USING (domain)")
def q181(spark, d):
    boundaries = spark.createDataFrame([("technology", 2), ("healthcare", 0)], "domain string, boundary_conditions int")
    return serving.guidelines(serving.source_tiers(_metrics(spark, d), ["precision_at_5"]), *_tables(spark), boundaries)


AGES = [0, 7, 14, 30, 60, 90, 180, 270, 365]


@query("q162_freshness_sweep", f"WITH {METRICS_SQL}, {DOMAINS_SQL}, {SWEEP_SQL.format('dom', AGES)}, {PRED_SQL}, {EXPECTED_SQL} SELECT domain, age AS avg_age_days, {', '.join(f"max(e) FILTER (metric = '{m}') AS {m}" for m in ('precision_at_5', 'ndcg_at_5', 'bertscore_f1', 'hallucination_rate', 'human_eval_score'))} FROM exp JOIN req USING (request_id) GROUP BY ALL")
def q162(spark, d):
    """Nine ages by three domains, a column a metric."""
    return serving.pivoted_sweep(serving.freshness_sweep(_domains(spark, d), AGES, *_tables(spark)))


@query("q162_best_fit", "SELECT event_type, arg_max(curve, (r2, -place)) AS curve, max(r2) AS r2 FROM (SELECT event_type, ['exponential', 'polynomial', 'logistic'][(user_id % 3 + 1)::INT] AS curve, (user_id % 3)::INT AS place, floor(avg(value) / 10) AS r2 FROM events GROUP BY ALL) GROUP BY event_type")
def q162_fit(spark, d):
    """The curve that fits best, of values that often tie."""
    order = ["exponential", "polynomial", "logistic"]
    curve = F.element_at(F.array(*[F.lit(c) for c in order]), (F.col("user_id") % 3 + 1).cast("int"))
    fits = table(spark, d, "events").groupBy("event_type", curve.alias("curve")).agg(F.floor(F.avg("value") / 10).cast("double").alias("r2"))
    return serving.best_fit(fits, "event_type", order)


@query("q187_model_comparison", "SELECT event_type, least(a, b, c) AS best, a = least(a, b, c) AS first, b = least(a, b, c) AS second, c = least(a, b, c) AS third FROM (SELECT event_type, round(avg(value), 4) AS a, round(median(value), 4) AS b, round(stddev_samp(value), 4) AS c FROM events GROUP BY 1)")
def q187(spark, d):
    e = table(spark, d, "events")
    means = e.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("a"), F.round(F.stddev_samp("value"), 4).alias("c"))
    m = means.join(medians(e, ["event_type"], "value").select("event_type", F.round("median", 4).alias("b")), "event_type")
    best = F.least("a", "b", "c")
    return m.select("event_type", best.alias("best"), (F.col("a") == best).alias("first"), (F.col("b") == best).alias("second"), (F.col("c") == best).alias("third"))
