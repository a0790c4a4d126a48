"""Tests on sufficient statistics: each cell is (n, mean, std), so no row is ever made up or moved."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def f_tail(spark: SparkSession, f: float, d1: float, d2: float) -> float:
    """Probability that an F variable exceeds f, from the math library that Spark ships."""
    if f is None or math.isnan(f) or d1 <= 0 or d2 <= 0:
        return float("nan")
    dist = spark._jvm.org.apache.commons.math3.distribution.FDistribution(None, float(d1), float(d2))
    return 1.0 - dist.cumulativeProbability(float(f))


def t_quantile(spark: SparkSession, p: float, df: float) -> float:
    return spark._jvm.org.apache.commons.math3.distribution.TDistribution(None, float(df)).inverseCumulativeProbability(float(p))


def interpret_eta(eta: Column) -> Column:
    return F.when(eta >= 0.14, "large").when(eta >= 0.06, "medium").when(eta >= 0.01, "small").otherwise("negligible")


def interpret_d(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a >= 0.8, "large").when(a >= 0.5, "medium").when(a >= 0.2, "small").otherwise("negligible")


def sums_of_squares(cells: DataFrame, by: list[str], group: str) -> DataFrame:
    """(by..., k, n, sst, ssb) of cells(by..., group, n, mean, std); groups are unions of cells."""
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    g = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    marked = cells.withColumn("__g", g)
    groups = marked.groupBy(*by, group).agg(
        F.sum("n").alias("gn"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("gm"),
        F.first("__g").alias("__mid"),
        F.sum((F.col("n") - 1) * F.col("std") * F.col("std") + F.col("n") * F.pow(F.col("mean") - F.col("__g"), F.lit(2))).alias("ss"),
    )
    return groups.groupBy(*by).agg(F.count("*").alias("k"), F.sum("gn").alias("n"), F.sum("ss").alias("sst"), F.sum(F.col("gn") * F.pow(F.col("gm") - F.col("__mid"), F.lit(2))).alias("ssb"))


def one_way(cells: DataFrame, by: list[str], group: str) -> DataFrame:
    """(by..., k, n, f, eta_squared, effect)."""
    s = sums_of_squares(cells, by, group)
    within = (F.col("sst") - F.col("ssb")) / (F.col("n") - F.col("k"))
    eta = F.when(F.col("sst") > 0, F.col("ssb") / F.col("sst")).otherwise(0.0)
    f = F.when((within > 0) & (F.col("k") > 1), F.col("ssb") / (F.col("k") - 1) / within)
    return s.select(*by, "k", "n", F.round(f, 6).alias("f"), F.round(eta, 6).alias("eta_squared"), interpret_eta(eta).alias("effect"))


def one_way_fallback(cells: DataFrame, by: list[str], factors: list[str]) -> DataFrame:
    """(by..., factor, k, n, f, eta_squared, effect): a one-way test of each factor by itself, for tables that a two-way test can't be made of; factors with one level have no row."""
    out = None
    for x in factors:
        one = one_way(cells, by, x).where("k > 1").withColumn("factor", F.lit(x))
        out = one if out is None else out.unionByName(one)
    return out.select(*by, "factor", "k", "n", "f", "eta_squared", "effect")


def with_p(tests: DataFrame, by: list[str]) -> DataFrame:
    """Adds p to one_way() results where they lie; null without an F."""

    @F.pandas_udf("double")
    def exceeds(f, k, n):
        import pandas as pd

        return pd.Series([f_exceeds(x, a - 1, c - a) for x, a, c in zip(f, k, n)], dtype=float)

    return tests.withColumn("p", F.round(exceeds(F.coalesce("f", F.lit(float("nan"))), "k", "n"), 6)).withColumn("p", F.when(~F.isnan("p"), F.col("p")))


def group_stats(cells: DataFrame, by: list[str], group: str) -> DataFrame:
    """(by..., group, n, mean, std) of groups that are unions of cells."""
    m = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    square = F.sum((F.col("n") - 1) * F.col("std") * F.col("std") + F.col("n") * F.col("mean") * F.col("mean"))
    s = cells.groupBy(*by, group).agg(F.sum("n").alias("n"), m.alias("mean"), square.alias("q"))
    var = (F.col("q") - F.col("n") * F.col("mean") * F.col("mean")) / (F.col("n") - 1)
    return s.select(*by, group, "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), var))).otherwise(0.0).alias("std"))


def pairwise(cells: DataFrame, by: list[str], group: str) -> DataFrame:
    """(by..., group1, group2, mean_diff, cohens_d): group2 less group1 in the difference, group1 less group2 in d."""
    g = group_stats(cells, by, group)
    a = g.select(*[F.col(b) for b in by], F.col(group).alias("group1"), F.col("n").alias("n1"), F.col("mean").alias("m1"), F.col("std").alias("s1"))
    b = g.select(*[F.col(x).alias(f"__{x}") for x in by], F.col(group).alias("group2"), F.col("n").alias("n2"), F.col("mean").alias("m2"), F.col("std").alias("s2"))
    rule = F.col("group1") < F.col("group2")
    for x in by:
        rule = rule & (F.col(x) == F.col(f"__{x}"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("s1") * F.col("s1") + (F.col("n2") - 1) * F.col("s2") * F.col("s2")) / (F.col("n1") + F.col("n2") - 2))
    d = F.when((F.col("n1") < 2) | (F.col("n2") < 2) | (pooled == 0), 0.0).otherwise((F.col("m1") - F.col("m2")) / pooled)
    return a.join(b, rule).select(*by, "group1", "group2", F.round(F.col("m2") - F.col("m1"), 6).alias("mean_diff"), F.round(d, 6).alias("cohens_d"), interpret_d(d).alias("effect"))


def two_way_main(cells: DataFrame, by: list[str], factor: str, other: str, reference) -> DataFrame:
    """(by..., f): a factor's effect in a complete two-way table with treatment coding, which is its effect at the other factor's reference level."""
    every = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("cells"), F.sum((F.col("n") - 1) * F.col("std") * F.col("std")).alias("sse"))
    at = sums_of_squares(cells.where(F.col(other) == F.lit(reference)), by, factor).select(*by, "k", "ssb")
    mse = F.col("sse") / (F.col("n") - F.col("cells"))
    return every.join(at, by).select(*by, F.round(F.col("ssb") / (F.col("k") - 1) / mse, 6).alias("f"))


def design_test(n: np.ndarray, mean: np.ndarray, full: np.ndarray, drop: list[int], mse: float) -> tuple[float, int]:
    """(F, degrees) of the columns in drop, by the weighted residual sums of squares with and without them; deficient ranks are counted as they are."""

    def rss(x: np.ndarray) -> tuple[float, int]:
        w = np.sqrt(n)
        beta, _, rank, _ = np.linalg.lstsq(x * w[:, None], mean * w, rcond=None)
        return float(((mean - x @ beta) ** 2 * n).sum()), int(rank)

    less = np.delete(full, drop, axis=1)
    (a, ra), (b, rb) = rss(full), rss(less)
    return (float((b - a) / (ra - rb) / mse), ra - rb) if ra > rb else (float("nan"), 0)


def f_exceeds(f: float, d1: float, d2: float) -> float:
    """f_tail() without the JVM, for tasks: the regularized incomplete beta function by its continued fraction (modified Lentz)."""
    if f != f or d1 <= 0 or d2 <= 0:
        return float("nan")
    if f <= 0:
        return 1.0
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    if x <= 0:
        return 1.0 if flip else 0.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    total = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    found = min(1.0, max(0.0, front * total))
    return 1 - found if flip else found


def two_way(cells: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """(by, term, f, df, p): type III tests of both factors and their interaction, also where cells are missing; each test in a task of its own, from its cells. Without a degree of freedom f and p are null."""
    import pandas as pd

    def test(part: pd.DataFrame) -> pd.DataFrame:
        part = part[part["n"] > 0]
        la, lb = sorted(part[a].unique()), sorted(part[b].unique())
        n, m = part["n"].to_numpy(float), part["mean"].to_numpy(float)
        rest = n.sum() - len(part)
        mse = ((n - 1) * part["std"].to_numpy(float) ** 2).sum() / rest if rest > 0 else 0.0
        xa = np.array([[float(v == x) for x in la[1:]] for v in part[a]]).reshape(len(part), -1)
        xb = np.array([[float(v == x) for x in lb[1:]] for v in part[b]]).reshape(len(part), -1)
        xi = np.einsum("ij,ik->ijk", xa, xb).reshape(len(part), -1)
        full = np.concatenate((np.ones((len(part), 1)), xa, xb, xi), axis=1)
        na, nb = xa.shape[1], xb.shape[1]
        out = []
        for term, cols in ((a, range(1, 1 + na)), (b, range(1 + na, 1 + na + nb)), (f"{a}:{b}", range(1 + na + nb, full.shape[1]))):
            f, df = design_test(n, m, full, list(cols), mse) if mse > 0 else (float("nan"), 0)
            known = not math.isnan(f)
            out.append((part[by].iloc[0], term, round(f, 4) if known else None, df, round(f_exceeds(f, df, rest), 6) if known else None))
        return pd.DataFrame(out, columns=[by, "term", "f", "df", "p"]).astype({"f": float, "p": float})

    some = cells.where("n > 0")
    return some.groupBy(by).applyInPandas(test, f"{by} {cells.schema[by].dataType.simpleString()}, term string, f double, df int, p double").withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("f", "p")})


def studentized_range_tail(q: float, k: int, df: float) -> float:
    """Probability that the range of k means over their error exceeds q, by numeric integration."""
    z = np.linspace(-8, 8, 801)
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = np.concatenate(([0.0], np.cumsum((phi[1:] + phi[:-1]) / 2 * (z[1] - z[0]))))
    # the scale s of the error, a chi variable over its root of degrees
    s = np.linspace(max(1e-3, 1 - 8 / math.sqrt(2 * df)), 1 + 8 / math.sqrt(2 * df), 241)
    log_density = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    density = np.exp(log_density)
    inner = np.array([np.trapezoid(k * phi * np.maximum(0, np.interp(z + q * x, z, cdf, right=1.0) - cdf) ** (k - 1), z) for x in s])
    return float(min(1.0, max(0.0, 1 - np.trapezoid(inner * density, s) / np.trapezoid(density, s))))


def studentized_range_quantile(p: float, k: int, df: float) -> float:
    """The q that the studentized range of k means exceeds with probability p, by bracketing and halving; 0 < p < 1."""
    low, high = 0.0, 4.0
    while studentized_range_tail(high, k, df) > p:
        low, high = high, 2 * high
        if high > 1e6:
            return float("inf")
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if studentized_range_tail(mid, k, df) > p else (low, mid)
        if high - low < 1e-9 * high:
            break
    return (low + high) / 2


def tukey(cells: DataFrame, by: str, group: str, alpha: float = 0.05) -> DataFrame:
    """(by, group1, group2, mean_diff, q, p, low, high, cohens_d, bonferroni_alpha, reject): honest significant differences with unequal counts.

    low and high are the simultaneous interval of group2 less group1 at 1 - alpha; cohens_d is of group1 less
    group2, so it has the other sign. bonferroni_alpha is alpha over the number of pairs and told only: reject
    goes by p. Each test is worked in a task of its own from its groups' counts, means and deviations; a test of
    one group, or without a degree of freedom or a deviation, has no row.
    """
    import pandas as pd

    kind = cells.schema[by].dataType.simpleString()
    names = ["group1", "group2", "mean_diff", "q", "p", "low", "high", "cohens_d", "bonferroni_alpha", "reject"]
    groups = group_stats(cells, [by], group).select(by, F.col(group).cast("string").alias("g"), F.col(group).alias("__o"), "n", "mean", "std").where("n > 0")

    def test(part: pd.DataFrame) -> pd.DataFrame:
        rows = list(part.sort_values("__o")[["g", "n", "mean", "std"]].itertuples(index=False))
        k, df = len(rows), sum(r.n for r in rows) - len(rows)
        mse = sum((r.n - 1) * r.std**2 for r in rows) / df if df > 0 else 0.0
        out = []
        if k > 1 and mse > 0:
            least = studentized_range_quantile(alpha, k, df)
            for i in range(k):
                for j in range(i + 1, k):
                    x, y = rows[i], rows[j]
                    diff, se = y.mean - x.mean, math.sqrt(mse / 2 * (1 / x.n + 1 / y.n))
                    p = studentized_range_tail(abs(diff) / se, k, df)
                    pooled = math.sqrt(((x.n - 1) * x.std**2 + (y.n - 1) * y.std**2) / (x.n + y.n - 2)) if min(x.n, y.n) > 1 else 0.0
                    d = -diff / pooled if pooled else 0.0
                    out.append((x.g, y.g, *[round(v, 4) for v in (diff, abs(diff) / se, p, diff - least * se, diff + least * se, d)], round(alpha / (k * (k - 1) / 2), 6), p < alpha))
        return pd.DataFrame(out, columns=names).assign(**{by: part[by].iloc[0]})[[by, *names]]

    return groups.groupBy(by).applyInPandas(test, f"{by} {kind}, group1 string, group2 string, mean_diff double, q double, p double, low double, high double, cohens_d double, bonferroni_alpha double, reject boolean")


def levene(rows: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """(by..., k, n, f): one-way F of distances from the group's median, over groups of two values or more. Medians are order statistics by rank, so that no group meets in one task."""
    from quarry.operators.order import medians

    keys = [*by, group]
    med = medians(rows, keys, value).where("n > 1").select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("median").alias("__m"))
    rule = F.lit(True)
    for c in keys:
        rule = rule & F.col(c).eqNullSafe(F.col(f"__{c}"))
    far = rows.join(med, rule).withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    cells = far.groupBy(*keys).agg(F.count("__d").alias("n"), F.avg("__d").alias("mean"), F.coalesce(F.stddev_samp("__d"), F.lit(0.0)).alias("std"))
    return one_way(cells, by, group).select(*by, "k", "n", "f")


def homogeneity(rows: DataFrame, by: list[str], group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """levene() with p and homogeneous; all three are null for a single group."""
    found = with_p(levene(rows, by, group, value), by)
    return found.withColumn("homogeneous", F.col("p") >= alpha)


#: Ranks whose expected normal values are summed in one row.
RANKS = 1 << 16


def shapiro_coefficients(n: int, norm: float, last: float, second: float) -> tuple[float, float | None, float]:
    """(a_n, a_n-1, root of phi) by Royston's approximation (1995), of the sum of squares of expected normal values and their two largest; a_n-1 is None for up to 5 values."""
    if n == 3:
        return math.sqrt(0.5), None, 1.0
    u, c = 1 / math.sqrt(n), math.sqrt(norm)
    an = last / c + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
    if n <= 5:
        return an, None, math.sqrt((norm - 2 * last**2) / (1 - 2 * an**2))
    an1 = second / c + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
    return an, an1, math.sqrt((norm - 2 * last**2 - 2 * second**2) / (1 - 2 * an**2 - 2 * an1**2))


def shapiro_p(w: float, n: int) -> float:
    """Probability of a lower W under normality, by the same paper's transformations; exact for three values."""
    from statistics import NormalDist

    if n == 3:
        return min(1.0, max(0.0, 6 / math.pi * (math.asin(math.sqrt(min(1.0, w))) - math.asin(math.sqrt(0.75)))))
    y, log_n = math.log(max(1 - w, 1e-19)), math.log(n)
    if n <= 11:
        gamma = 0.459 * n - 2.273
        if y >= gamma:
            return 1e-19
        y = -math.log(gamma - y)
        mu = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sigma = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        mu = 0.0038915 * log_n**3 - 0.083751 * log_n**2 - 0.31082 * log_n - 1.5861
        sigma = math.exp(0.0030302 * log_n**2 - 0.082676 * log_n - 0.4803)
    return 1 - NormalDist().cdf((y - mu) / sigma)


def shapiro_wilk(rows: DataFrame, by: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """(by..., n, w, p, normal) of each group: the Shapiro-Wilk test, null for fewer than three values and for values that are all equal.

    The expected normal value of a rank hangs on the rank and the count alone, so W is a ratio of sums over
    ranks: groups of any size are ranked by distinct values and summed by aggregates, and a long run of equal
    values is dealt out by RANKS ranks. p is meant for up to 5,000 values; beyond, it is an extrapolation.
    """
    from quarry.operators.order import at_rank, cumulative

    spark = rows.sparkSession
    ranked = cumulative(rows, by, value)
    starts = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RANKS).cast("long"))
    spans = ranked.withColumn("__from", F.explode(starts)).select(*by, "value", "total", (F.col("before") + F.col("__from")).alias("__first"), F.least(F.lit(RANKS).cast("long"), F.col("n") - F.col("__from")).alias("__many"))

    @F.pandas_udf("struct<s: double, q: double>")
    def normal_sums(first, many, total):
        """Sum and sum of squares of the expected normal values of a span of ranks."""
        from statistics import NormalDist

        import pandas as pd

        inverse, out = NormalDist().inv_cdf, []
        for a, m, n in zip(first.tolist(), many.tolist(), total.tolist()):
            x = np.fromiter((inverse((i + 1 - 0.375) / (n + 0.25)) for i in range(a, a + m)), float, m)
            out.append((float(x.sum()), float(x @ x)))
        return pd.DataFrame(out, columns=["s", "q"])

    m = spans.withColumn("__m", normal_sums("__first", "__many", "total"))
    sums = m.groupBy(*by).agg(F.sum(F.col("value") * F.col("__m.s")).alias("mx"), F.sum("__m.q").alias("mm"))
    t = F.col("total")
    x, k = F.col("value"), F.col("n")
    ends = ranked.groupBy(*by).agg(F.max("total").alias("n"), (F.sum(x * k) / F.sum(k)).alias("mean"), F.min("value").alias("x1"), at_rank(F.lit(2)).alias("x2"), at_rank(t - 1).alias("y2"), F.max("value").alias("y1"))
    # the sum of squares around the mean in a second pass, as large values would cancel out
    mean = ends.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("mean").alias("__mean"))
    rule = F.lit(True)
    for b in by:
        rule = rule & F.col(b).eqNullSafe(F.col(f"__{b}"))
    ss = ranked.join(mean, rule).groupBy(*by).agg(F.sum(k * (x - F.col("__mean")) * (x - F.col("__mean"))).alias("ss"))

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        other = b.withColumnsRenamed({c: f"__{c}" for c in by})
        return a.join(other, rule).drop(*[f"__{c}" for c in by])

    both = joined(joined(ends, sums), ss) if by else ends.crossJoin(sums).crossJoin(ss)  # one row each

    @F.pandas_udf("struct<w: double, p: double>")
    def decide(n, mx, mm, x1, x2, y2, y1, ss):
        from statistics import NormalDist

        import pandas as pd

        inverse, out = NormalDist().inv_cdf, []
        for count, mx_, mm_, a, b, c, d, total in zip(*(v.tolist() for v in (n, mx, mm, x1, x2, y2, y1, ss))):
            if count < 3 or not total or total <= 0:
                out.append((None, None))
                continue
            last, second = inverse((count - 0.375) / (count + 0.25)), inverse((count - 1.375) / (count + 0.25))
            an, an1, root = shapiro_coefficients(count, mm_, last, second)
            rest = mx_ - last * (d - a) - (second * (c - b) if an1 is not None else 0.0)
            up = an * (d - a) + (an1 * (c - b) if an1 is not None else 0.0) + (rest / root if count > 3 else 0.0)
            w = min(1.0, up * up / total)
            out.append((round(w, 6), round(shapiro_p(w, count), 6)))
        return pd.DataFrame(out, columns=["w", "p"], dtype="object" if any(x[0] is None for x in out) else float)

    done = both.withColumn("__t", decide("n", "mx", "mm", "x1", "x2", "y2", "y1", "ss"))
    return done.select(*by, "n", F.col("__t.w").alias("w"), F.col("__t.p").alias("p"), (F.col("__t.p") >= alpha).alias("normal"))


def t_interval(values: DataFrame, by: list[str], value: str, quantile: float) -> DataFrame:
    """(by..., n, mean, low, high): mean plus and minus quantile standard errors; (0, 0) for fewer than two values."""
    s = values.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    half = F.lit(quantile) * F.col("s") / F.sqrt("n")
    end = lambda c: F.round(F.when(F.col("n") < 2, 0.0).otherwise(c), 6)
    return s.select(*by, "n", F.round("m", 6).alias("mean"), end(F.col("m") - half).alias("low"), end(F.col("m") + half).alias("high"))


def marginal_gains(levels: DataFrame, by: list[str]) -> DataFrame:
    """(by..., gain_12, gain_23, total, share_12, share_23, dominant) of levels(by..., level 1 to 3, mean)."""
    at = lambda k: F.max(F.when(F.col("level") == k, F.col("mean")))
    s = levels.groupBy(*by).agg(at(1).alias("l1"), at(2).alias("l2"), at(3).alias("l3"))
    a, b, t = F.col("l2") - F.col("l1"), F.col("l3") - F.col("l2"), F.col("l3") - F.col("l1")
    share = lambda x: F.when(t != 0, F.round(100 * x / t, 2))
    return s.select(*by, F.round(a, 6).alias("gain_12"), F.round(b, 6).alias("gain_23"), F.round(t, 6).alias("total"), share(a).alias("share_12"), share(b).alias("share_23"), F.when(F.abs(b) > F.abs(a), "technical").otherwise("news").alias("dominant"))
