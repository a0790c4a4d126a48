"""Regression and decay curves; forests and boosted trees are in trees.py."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The features of the models.
BASE = ["freshness_score", "source_diversity_index", "domain_volatility", "fresh_x_diversity", "fresh_x_volatility", "source_x_volatility"]
SQUARES = ["freshness_score_sq", "source_diversity_index_sq", "domain_volatility_sq"]


def features(rows: DataFrame, fresh: str = "freshness_score", sdi: str = "source_diversity_index", vol: str = "domain_volatility", squares: bool = False) -> DataFrame:
    """Adds the three interactions, and the squares where asked."""
    f, s, v = F.col(fresh), F.col(sdi), F.col(vol)
    new = {"fresh_x_diversity": f * s, "fresh_x_volatility": f * v, "source_x_volatility": s * v}
    if squares:
        new |= {"freshness_score_sq": f * f, "source_diversity_index_sq": s * s, "domain_volatility_sq": v * v}
    return rows.withColumns(new)


def normal_equations(rows: DataFrame, target: str, names: list[str]) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """(X'X, X'y, y'y, sum of y, n) with an intercept, in one aggregate."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    y = F.col(target).cast("double")
    kept = rows.where(y.isNotNull())
    p = len(x)
    sums = [F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)] + [F.sum(x[i] * y).alias(f"b{i}") for i in range(p)] + [F.sum(y * y).alias("yy"), F.sum(y).alias("sy"), F.count("*").alias("n")]
    r = kept.agg(*sums).first()
    a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)])
    return a, np.array([r[f"b{i}"] or 0.0 for i in range(p)]), r["yy"] or 0.0, r["sy"] or 0.0, r["n"]


def ols(rows: DataFrame, target: str, names: list[str]) -> DataFrame:
    """(feature, coef, std_err, t, p, r2, adj_r2, f, n) by the normal equations: one pass over the rows, then a small solve."""
    spark = rows.sparkSession
    a, b, yy, sy, n = normal_equations(rows, target, names)
    inverse = np.linalg.pinv(a)
    beta = inverse @ b
    rank = int(np.linalg.matrix_rank(a))
    sse = max(0.0, yy - beta @ b)
    sst = yy - sy * sy / n if n else 0.0
    df = max(1, n - rank)
    se = np.sqrt(np.maximum(0, np.diag(inverse)) * sse / df)
    r2 = 1 - sse / sst if sst > 0 else 0.0
    adj = 1 - (1 - r2) * (n - 1) / df
    f = (r2 / max(1, rank - 1)) / ((1 - r2) / df) if r2 < 1 else 0.0
    dist = spark._jvm.org.apache.commons.math3.distribution.TDistribution(None, float(df))
    out = []
    for name, c, s in zip(["intercept", *names], beta, se):
        t = float(c / s) if s > 0 else 0.0
        out.append((name, round(float(c), 6), round(float(s), 6), round(t, 6), round(2 * (1 - dist.cumulativeProbability(abs(t))), 6), round(float(r2), 6), round(float(adj), 6), round(float(f), 4), n))
    return spark.createDataFrame(out, "feature string, coef double, std_err double, t double, p double, r2 double, adj_r2 double, f double, n long")


def moderated(rows: DataFrame, target: str, factor: str, moderator: str) -> DataFrame:
    """ols() on a factor, a moderator and their product."""
    product = f"{factor}_x_{moderator}"
    return ols(rows.withColumn(product, F.col(factor) * F.col(moderator)), target, [factor, moderator, product])


def fold(key: Column, folds: int = 10, seed: int = 42) -> Column:
    """A row's fold, by hash: the same for every partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int")


def ols_cv(rows: DataFrame, target: str, names: list[str], key: str, folds: int = 10) -> DataFrame:
    """(mae_mean, mae_std, rmse_mean, rmse_std) over folds: one pass gathers each fold's equations, a fit leaves its fold out by subtraction, a second pass scores."""
    spark = rows.sparkSession
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    y = F.col(target).cast("double")
    p = len(x)
    marked = rows.where(y.isNotNull()).withColumn("__fold", fold(F.col(key), folds))
    sums = [F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)] + [F.sum(x[i] * y).alias(f"b{i}") for i in range(p)]
    parts = {r["__fold"]: r for r in marked.groupBy("__fold").agg(*sums).collect()}
    mats = {k: (np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]), np.array([r[f"b{i}"] for i in range(p)])) for k, r in parts.items()}
    ta, tb = sum(m[0] for m in mats.values()), sum(m[1] for m in mats.values())
    betas = [(k, np.linalg.lstsq(ta - a, tb - b, rcond=None)[0].tolist()) for k, (a, b) in mats.items()]
    coef = F.broadcast(spark.createDataFrame(betas, "__fold int, beta array<double>"))
    guess = sum((F.col("beta")[i] * x[i] for i in range(1, p)), F.col("beta")[0] * x[0])
    err = marked.join(coef, "__fold").select("__fold", (y - guess).alias("e"))
    per = err.groupBy("__fold").agg(F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))
    return per.agg(*[F.round(f(c), 6).alias(f"{c}_{n}") for c in ("mae", "rmse") for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def simple_regression(rows: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """(by..., slope, intercept, r2, n) by built-in aggregates."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    s = rows.groupBy(*by).agg(F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2"), F.regr_count(a, b).alias("n"))
    return s.select(*by, *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")], "n")


#: Bins that a group's range of x is cut into for the curves that need more than sums.
CURVE_BINS = 4096


def decay_fits(rows: DataFrame, by: str, x: str, y: str, least: int = 4) -> DataFrame:
    """(by, curve, params, r2): polynomial (quadratic) by its exact equations, exponential and logistic by damped Gauss-Newton.

    The quadratic needs sums of powers only, which are taken over all rows. The other two are fitted to the means
    of CURVE_BINS bins of the group's own range of x, each at the mean of its x, so that the unit of x does not
    matter and a group of any size is a table of bounded size in one task. R2 is over all rows. Null and NaN
    values are left out; groups with fewer than least rows or three different x have no fit.
    """
    import pandas as pd

    t, v = F.col(x).cast("double"), F.col(y).cast("double")
    picked = rows.where(t.isNotNull() & v.isNotNull() & ~F.isnan(t) & ~F.isnan(v)).select(F.col(by).alias("__by"), t.alias("__x"), v.alias("__y"))
    ends = picked.groupBy(F.col("__by").alias("__key")).agg(F.min("__x").alias("__low"), F.max("__x").alias("__high"))
    # x from 0 to 1 within its group, so that powers are of one size
    unit = F.when(F.col("__high") > F.col("__low"), (F.col("__x") - F.col("__low")) / (F.col("__high") - F.col("__low"))).otherwise(0.0)
    both = picked.join(ends, F.col("__by").eqNullSafe(F.col("__key"))).withColumn("__u", unit)
    u, w = F.col("__u"), F.col("__y")
    powers = [F.sum(F.pow(u, F.lit(float(k)))).alias(f"p{k}") for k in range(1, 5)] + [F.sum(F.pow(u, F.lit(float(k))) * w).alias(f"q{k}") for k in range(1, 3)]
    bins = both.groupBy("__by", F.least(F.floor(u * CURVE_BINS), F.lit(CURVE_BINS - 1)).alias("__bin")).agg(
        F.first("__low").alias("low"), F.first("__high").alias("high"), F.count("*").alias("n"), F.sum(w).alias("sy"), F.sum(w * w).alias("syy"), *powers, F.min(u).alias("least"), F.max(u).alias("most")
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["__by"].iloc[0]
        n = pdf["n"].to_numpy(float)
        whole = {c: float(pdf[c].sum()) for c in ("sy", "syy", *(f"p{k}" for k in range(1, 5)), "q1", "q2")}
        count, low, span = float(n.sum()), float(pdf["low"].iloc[0]), float(pdf["high"].iloc[0] - pdf["low"].iloc[0])
        different = len(set(pdf["least"]) | set(pdf["most"]))
        if count < least or different < 3:
            none = pd.Series([], dtype=object)
            return pd.DataFrame({by: none, "curve": none, "params": none, "r2": pd.Series([], dtype=float)})
        total = whole["syy"] - whole["sy"] ** 2 / count
        t, m = pdf["p1"].to_numpy() / n, pdf["sy"].to_numpy(float) / n
        within = whole["syy"] - float((m * m * n).sum())
        a = np.array([[whole["p4"], whole["p3"], whole["p2"]], [whole["p3"], whole["p2"], whole["p1"]], [whole["p2"], whole["p1"], count]])
        c = np.linalg.lstsq(a, np.array([whole["q2"], whole["q1"], whole["sy"]]), rcond=None)[0]
        left = whole["syy"] - 2 * c @ [whole["q2"], whole["q1"], whole["sy"]] + c @ a @ c
        # from the unit interval back to x
        quad = [c[0] / span**2, c[1] / span - 2 * c[0] * low / span**2, c[2] - c[1] * low / span + c[0] * low**2 / span**2]
        out = [("polynomial", quad, left)]
        root = np.sqrt(n)
        exp_ = lambda p: p[0] * np.exp(np.clip(-p[1] * t, -50, 50)) + p[2]
        log_ = lambda p: p[0] / (1 + np.exp(np.clip(-p[1] * (t - p[2]), -50, 50)))
        # fitted over the unit interval, so that the unit of x does not matter, and told in x
        curves = (
            ("exponential", exp_, [m.max() - m.min() + 1e-3, 1.0, m.min()], lambda p: [p[0] * np.exp(np.clip(p[1] * low / span, -50, 50)), p[1] / span, p[2]]),
            ("logistic", log_, [max(m.max(), 1e-3), 1.0, float(np.average(t, weights=n))], lambda p: [p[0], p[1] / span, low + span * p[2]]),
        )
        for name, f, start, told in curves:
            p, damp = np.array(start, float), 1e-2
            best = ((m - f(p)) ** 2 * n).sum()
            for _ in range(200):
                base = f(p)
                jac = np.stack([(f(p + h) - base) / 1e-6 for h in np.eye(3) * 1e-6], 1) * root[:, None]
                h = jac.T @ jac
                step = np.linalg.lstsq(h + damp * np.diag(np.diag(h) + 1e-9), jac.T @ ((m - base) * root), rcond=None)[0]
                now = ((m - f(p + step)) ** 2 * n).sum()
                if now < best:
                    done = best - now < 1e-12 * (1 + best)
                    p, best, damp = p + step, now, damp / 3
                    if done:
                        break
                else:
                    damp *= 4
                    if damp > 1e12:
                        break
            out.append((name, told(p), within + best))
        r2 = [1 - rest / total if total > 0 else 0.0 for _, _, rest in out]
        return pd.DataFrame({by: [key] * len(out), "curve": [c for c, _, _ in out], "params": [[round(float(v), 6) for v in p] for _, p, _ in out], "r2": [round(float(v), 6) for v in r2]})

    return bins.groupBy("__by").applyInPandas(fit, f"{by} {rows.schema[by].dataType.simpleString()}, curve string, params array<double>, r2 double")


#: The targets that have the long list of features, with squares and what retrieval told; others have the short one.
LONG_TARGETS = ["human_eval_score"]
RETRIEVAL = ["avg_similarity", "min_similarity", "relevant_doc_count", "n_docs"]


def feature_set(target: str, available: list[str]) -> list[str]:
    """The features of a target's models, of those that the frame has."""
    wanted = [*BASE, *RETRIEVAL, *(SQUARES if target in LONG_TARGETS else [])]
    return [c for c in wanted if c in available]


def fan_out(rows: DataFrame, targets: list[str], fit) -> DataFrame:
    """fit(rows, target, names) for each target that the frame has and that some row has a value of, with its name before the result's columns; the targets are few."""
    there = rows.agg(F.lit(0), *[F.count(t).alias(t) for t in targets if t in rows.columns]).first()
    out = None
    for t in [t for t in targets if t in rows.columns and there[t]]:
        one = fit(rows, t, feature_set(t, rows.columns))
        one = one.select(F.lit(t).alias("target"), *one.columns)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError(f"no row has a value of any of {targets}")
    return out
