"""Forests and boosted trees over binned features, with 64 bins at every size of input and all rows in every fit.

Rows are binned and counted into cells first: a cell is a combination of feature bins, and of the part (fold or
group) that a fit may leave out, with its number of rows and the sum of their targets. Grids, folds, held-out
groups and forests are many fits over the same cells, so while there are at most MAX_CELLS of them, which is
checked, each fit takes them as one table in a task of its own. Beyond that the fits are those of pyspark.ml over
the binned rows where they lie, one after another. Errors are taken over all rows again, not over cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a feature at most; cells up to which a fit takes them as one table.
BINS, MAX_CELLS = 64, 1 << 17
#: Trees of a forest that are grown at a time.
TOGETHER = 16


def binned(rows: DataFrame, names: list[str], target: str, bins: int = BINS) -> DataFrame:
    """rows without null features and targets, with a bin b0, b1, ... for each feature by approximate quantiles, and label."""
    picked = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*names, target]))
    picked = picked.withColumns({f"__{c}": F.col(c).cast("double") for c in names}).withColumn("label", F.col(target).cast("double"))
    shares = [k / bins for k in range(1, bins)]
    cuts = picked.agg(*[F.percentile_approx(f"__{c}", shares, 10000).alias(c) for c in names]).first()
    below = lambda c: [float(x) for x in sorted(set(cuts[c] or []))]

    def place(name: str) -> Column:
        value = F.col(f"__{name}")
        return F.size(F.filter(F.array(*[F.lit(x) for x in below(name)]).cast("array<double>"), lambda x: x < value))

    return picked.withColumns({f"b{k}": place(c) for k, c in enumerate(names)}).drop(*[f"__{c}" for c in names])


def cells(rows: DataFrame, names: list[str], target: str, part: Column) -> tuple[DataFrame, pd.DataFrame | None]:
    """(binned rows with part, the table of cells): b0, b1, ..., part, n and sum of label. The table is None if there are more than MAX_CELLS of them; no row is left out in either case."""
    keys = [f"b{k}" for k in range(len(names))]
    marked = binned(rows, names, target).withColumn("part", part)
    table = marked.groupBy(*keys, "part").agg(F.count("*").alias("n"), F.sum("label").alias("s"))
    found = table.limit(MAX_CELLS + 1).toPandas()
    return marked, None if len(found) > MAX_CELLS else found.sort_values([*keys, "part"], kind="stable").reset_index(drop=True)


def assembled(marked: DataFrame, count: int) -> DataFrame:
    """Binned rows as pyspark.ml takes them: features, label, part."""
    from pyspark.ml.feature import VectorAssembler

    put = VectorAssembler(inputCols=[f"b{k}" for k in range(count)], outputCol="features")
    return put.transform(marked).select("features", "label", "part")


def ml_forest(trees: int, depth: int | None = None, least_split: int = 2, least_leaf: int = 1, features: float | None = None, seed: int = 42):
    """The forest of pyspark.ml with these settings. It knows no least size of a node to split, so that leaves of half that size stand for it, and no depth beyond 30."""
    from pyspark.ml.regression import RandomForestRegressor

    least, subset = max(least_leaf, -(-least_split // 2)), "all" if features is None else str(max(1, int(features)))
    return RandomForestRegressor(numTrees=trees, maxDepth=30 if depth is None else depth, minInstancesPerNode=least, featureSubsetStrategy=subset, maxBins=BINS, seed=seed)


def ml_boosted(rounds: int = 300, rate: float = 0.05, depth: int = 4, rows: float = 0.8, columns: float = 0.8, seed: int = 42, **_):
    """The boosted trees of pyspark.ml with these settings; it has no penalty on leaves."""
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(maxIter=rounds, stepSize=rate, maxDepth=depth, subsamplingRate=rows, featureSubsetStrategy=str(columns), maxBins=BINS, seed=seed)


def ml_errors(data: DataFrame, estimator, stay: Column, own: Column) -> tuple[dict[str, float], list[float]]:
    """(mae, rmse, r2, n, and means and deviation of the errors over rows of own, importances) of a fit over rows of stay."""
    model = estimator.fit(data.where(stay))
    e = F.col("prediction") - F.col("label")
    found = model.transform(data.where(own)).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / (F.var_pop("label") * F.count("*"))).alias("r2"),
        F.count("*").alias("n"), F.avg("label").alias("a"), F.avg("prediction").alias("p"), F.stddev_samp(e).alias("s"),
    )
    return found.first().asDict(), model.featureImportances.toArray().tolist()


def _strength(g: np.ndarray, h: np.ndarray, lam: float, alpha: float) -> np.ndarray:
    """What a leaf takes off the loss, twice, by its gradient and weight."""
    g = np.maximum(np.abs(g) - alpha, 0.0)
    return np.where(h > 0, g * g / np.maximum(h + lam, 1e-12), 0.0)


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int | None, least_split: float, least_leaf: float, lam: float, alpha: float, allowed: Callable[[int], np.ndarray], tree: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value by row of x, gain and splits by tree and feature) of trees, grown level by level over all nodes at once; tree says which one a row belongs to, one if not given.

    g and h are sums by row of x; rows with h of 0 are routed and don't count. allowed(nodes) says which features a node may split.
    """
    n, p = x.shape
    bins = int(x.max()) + 1 if n else 1
    node = np.zeros(n, np.int64) if tree is None else tree
    count = 1 if tree is None else int(tree.max()) + 1
    root = np.arange(count)
    gain, splits = np.zeros((count, p)), np.zeros((count, p))
    open_, level = np.ones(count, bool), 0
    while open_.any() and (depth is None or level < depth) and level < 64:
        count = len(open_)
        whole_g, whole_h = np.bincount(node, g, count), np.bincount(node, h, count)
        strength = _strength(whole_g, whole_h, lam, alpha)
        best, at, by = np.full(count, 1e-9), np.zeros(count, np.int64), np.full(count, -1)
        free = allowed(count) & (open_ & (whole_h >= least_split))[:, None]
        live = np.flatnonzero(free.any(axis=1)[node] & (h > 0))
        for f in range(p):
            # rows by node and bin: a split lies behind each bin but a node's last
            of = live[free[node[live], f]]
            key = node[of] * bins + x[of, f]
            order = np.argsort(key, kind="stable")
            key, of = key[order], of[order]
            own = key // bins
            ends = np.flatnonzero((key[1:] != key[:-1]) & (own[1:] == own[:-1]))
            if not len(ends):
                continue
            sums = np.cumsum(np.stack((g[of], h[of])), axis=1)
            start = np.searchsorted(own, own[ends])
            lg, lh = sums[:, ends] - np.where(start > 0, sums[:, start - 1], 0.0)
            own = own[ends]
            rg, rh = whole_g[own] - lg, whole_h[own] - lh
            won = _strength(lg, lh, lam, alpha) + _strength(rg, rh, lam, alpha) - strength[own]
            won[(lh < least_leaf) | (rh < least_leaf)] = -1.0
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            most = np.maximum.reduceat(won, first)
            top = np.flatnonzero(won == np.repeat(most, np.diff(np.append(first, len(won)))))
            top = top[np.concatenate(([True], own[top][1:] != own[top][:-1]))]
            better = top[won[top] > best[own[top]] + 1e-12]
            best[own[better]], at[own[better]], by[own[better]] = won[better], key[ends[better]] % bins, f
        split = by >= 0
        np.add.at(gain, (root[split], by[split]), best[split])
        np.add.at(splits, (root[split], by[split]), 1)
        # children of split nodes come in pairs after the leaves, which keep their place in order
        place = np.where(split, np.cumsum(1 + split) - 2, np.cumsum(1 + split) - 1)
        right = split[node] & (x[np.arange(n), by[node]] > at[node])
        node, open_, root = place[node] + right, np.repeat(split, 1 + split), np.repeat(root, 1 + split)
        level += 1
    count = len(open_)
    total, weight = np.bincount(node, g, count), np.bincount(node, h, count)
    leaf = -np.sign(total) * np.maximum(np.abs(total) - alpha, 0.0) / np.maximum(weight + lam, 1e-12)
    return np.where(weight > 0, leaf, 0.0)[node], gain, splits


def forest(x: np.ndarray, n: np.ndarray, s: np.ndarray, trees: int, depth: int | None = None, least_split: int = 2, least_leaf: int = 1, features: float | None = None, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(prediction by cell, importances): the mean of trees, each over a bootstrap by Poisson counts of the cells' rows; features: how many a node looks at."""
    rng = np.random.default_rng(seed)
    p = x.shape[1]
    many = p if features is None else max(1, int(features))
    mean = np.divide(s, n, out=np.zeros(len(n)), where=n > 0)
    centre = s.sum() / max(1.0, n.sum())
    total, weight = np.zeros(len(n)), np.zeros(p)

    def allowed(count: int) -> np.ndarray:
        return np.ones((count, p), bool) if many == p else rng.random((count, p)).argsort(axis=1) < many

    # some trees at a time, as a single small one is all overhead
    for a in range(0, trees, TOGETHER):
        many_trees = min(TOGETHER, trees - a)
        w = rng.poisson(n, (many_trees, len(n))).astype(float).ravel()
        value, gain, _ = grow(np.tile(x, (many_trees, 1)), w * np.tile(centre - mean, many_trees), w, depth, least_split, least_leaf, 0.0, 0.0, allowed, np.repeat(np.arange(many_trees), len(n)))
        total += value.reshape(many_trees, -1).sum(axis=0)
        weight += (gain / np.maximum(gain.sum(axis=1, keepdims=True), 1e-12)).sum(axis=0)
    return centre + total / trees, weight / max(1e-12, weight.sum())


def boosted(x: np.ndarray, n: np.ndarray, s: np.ndarray, rounds: int = 300, rate: float = 0.05, depth: int = 4, rows: float = 0.8, columns: float = 0.8, lam: float = 1.0, alpha: float = 0.1, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(prediction by cell, importances by mean gain): rounds of shrunken trees on what is left, each over a part of the rows and features."""
    rng = np.random.default_rng(seed)
    p = x.shape[1]
    mean = np.divide(s, n, out=np.zeros(len(n)), where=n > 0)
    guess = np.full(len(n), s.sum() / max(1.0, n.sum()))
    gain, splits = np.zeros(p), np.zeros(p)
    for _ in range(rounds):
        w = rng.binomial(n.astype(np.int64), rows).astype(float)
        pick = np.zeros(p, bool)
        pick[rng.permutation(p)[: max(1, round(columns * p))]] = True
        value, one, times = grow(x, w * (guess - mean), w, depth, 2, 1, lam, alpha, lambda count, pick=pick: np.tile(pick, (count, 1)))
        guess = guess + rate * value
        gain, splits = gain + one[0], splits + times[0]
    each = gain / np.maximum(splits, 1)
    return guess, each / max(1e-12, each.sum())


def fits(spark, table: pd.DataFrame, jobs: list[tuple], held: Callable, fit: Callable) -> pd.DataFrame:
    """Rows (job, preds by cell, importances) of a fit for every job, each in a task of its own.

    held(parts, job) says which parts a job leaves out; fit(x, n, s, job) gets the others, summed over the parts.
    """
    shared = spark.sparkContext.broadcast(table)
    count = sum(c.startswith("b") for c in table.columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        x, at = np.unique(t[[f"b{k}" for k in range(count)]].to_numpy(np.int64), axis=0, return_inverse=True)
        at = at.ravel()
        for frame in frames:
            for j in frame["job"]:
                stay = ~np.asarray(held(t["part"].to_numpy(), jobs[j]), bool)
                n, s = (np.bincount(at[stay], t[c].to_numpy(float)[stay], len(x)) for c in ("n", "s"))
                preds, weight = fit(x, n, s, jobs[j])
                yield pd.DataFrame({"job": [j], "preds": [preds[at].tolist()], "importances": [weight.tolist()]})

    asked = spark.createDataFrame([(j,) for j in range(len(jobs))], "job int").repartition(max(1, len(jobs)), "job")
    return asked.mapInPandas(run, "job int, preds array<double>, importances array<double>").toPandas().sort_values("job").reset_index(drop=True)


def errors(marked: DataFrame, table: pd.DataFrame, preds: pd.DataFrame, of: Column) -> DataFrame:
    """marked rows with preds, the array of predictions of their cell; preds has a column a prediction, in the order of table. of is unused rows' mark, which are left out."""
    keys = [c for c in table.columns if c not in ("n", "s")]
    kinds = ", ".join(f"{k} {marked.schema[k].dataType.simpleString()}" for k in keys)
    side = list(zip(*[table[k].tolist() for k in keys], preds.to_numpy(float).tolist()))
    return marked.where(of).join(marked.sparkSession.createDataFrame(side, f"{kinds}, preds array<double>"), keys)


def fold(key: Column, folds: int, seed: int = 42) -> Column:
    """A row's fold by hash, the same for every partitioning; large strata are spread evenly over the folds."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int")


#: The grid of the query-level forest.
GRID = {"depth": [None, 10, 20], "least_split": [2, 5], "least_leaf": [1, 2]}
#: That of the condition-level forest.
SMALL_GRID = {"depth": [None, 3, 5], "least_leaf": [1, 2], "features": ["sqrt", "log2"]}


def forest_search(rows: DataFrame, target: str, names: list[str], key: str, grid: dict = GRID, trees: int = 500, search_folds: int = 5, folds: int = 10, by: str = "mae") -> tuple[DataFrame, DataFrame]:
    """(importances(feature, importance), bounds(parameters, mae_mean, mae_std, rmse_mean, rmse_std, r2_mean, n)).

    Every combination of the grid is fitted in search_folds folds; that with the least mean absolute error (or
    the best R2) is fitted to all rows, for importances, and in folds, for errors over held-out rows.
    """
    spark = rows.sparkSession
    both = search_folds * folds
    marked, table = cells(rows, names, target, fold(F.col(key), both))
    marked = marked.select(*[f"b{k}" for k in range(len(names))], "part", "label").cache()
    n = int(table["n"].sum()) if table is not None else marked.count()
    choices = [dict(zip(grid, c)) for c in product(*grid.values())]
    size = {"sqrt": np.sqrt(len(names)), "log2": np.log2(len(names))}
    choices = [{k: size.get(v, v) if k == "features" else v for k, v in c.items()} for c in choices]

    def held(parts, job):
        return parts % job[1] == job[2] if job[1] else np.zeros(len(parts), bool)

    def fit(x, n, s, job):
        return forest(x, n, s, trees, **choices[job[0]])

    def scored(jobs: list[tuple], base: int) -> pd.DataFrame:
        """Errors of jobs (choice, base, fold) by choice and fold."""
        found = fits(spark, table, jobs, held, fit)
        preds = pd.DataFrame(dict(enumerate(found["preds"])))
        width = len(jobs) // base
        wide = errors(marked, table, preds, F.lit(True)).withColumn("f", F.pmod("part", F.lit(base)))
        # jobs lie by fold, so a row's own are a slice
        own = wide.select("f", "label", F.posexplode(F.slice("preds", F.col("f") * width + 1, width)).alias("c", "p"))
        e = F.col("p") - F.col("label")
        done = own.groupBy("c", "f").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / (F.var_pop("label") * F.count("*"))).alias("r2"))
        return done.toPandas()

    def scored_by_ml(jobs: list[tuple], base: int) -> pd.DataFrame:
        data, at = assembled(marked, len(names)).cache(), F.pmod("part", F.lit(base))
        out = [{"c": c, "f": f} | ml_errors(data, ml_forest(trees, **choices[c]), at != f, at == f)[0] for c, _, f in jobs]
        data.unpersist()
        return pd.DataFrame(out)

    if table is None:
        scored = scored_by_ml  # noqa: F811
    try:
        first = scored([(c, search_folds, f) for f in range(search_folds) for c in range(len(choices))], search_folds).groupby("c")[by].mean()
        best = int(first.idxmin() if by == "mae" else first.idxmax()) if len(first) else 0
        last = scored([(best, folds, f) for f in range(folds)], folds)
        weight = fits(spark, table, [(best, 0, 0)], held, fit)["importances"][0] if table is not None else ml_forest(trees, **choices[best]).fit(assembled(marked, len(names))).featureImportances.toArray().tolist()
    finally:
        marked.unpersist()
    told = ", ".join(f"{k}={v}" for k, v in choices[best].items())
    mean = lambda c: round(float(last[c].mean()), 6) if len(last) else 0.0
    dev = lambda c: round(float(last[c].std(ddof=0)), 6) if len(last) else 0.0
    bounds = spark.createDataFrame([(told, mean("mae"), dev("mae"), mean("rmse"), dev("rmse"), mean("r2"), n)], "parameters string, mae_mean double, mae_std double, rmse_mean double, rmse_std double, r2_mean double, n long")
    return ranked(weight, names, spark), bounds


def ranked(weight: list[float], names: list[str], spark) -> DataFrame:
    values = [(c, round(float(v), 6)) for c, v in zip(names, weight)]
    return spark.createDataFrame(values, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def boosted_search(rows: DataFrame, target: str, names: list[str], key: str, folds: int = 10, **settings) -> tuple[DataFrame, DataFrame]:
    """(importances, bounds) as forest_search: means over folds; a fit sees four fifths of the rows outside its fold, by hash, as the rest is set aside for validation."""
    spark = rows.sparkSession
    marked, table = cells(rows, names, target, fold(F.col(key), folds * 5))
    marked = marked.select(*[f"b{k}" for k in range(len(names))], "part", "label")

    def held(parts, job):
        return (parts % folds == job[0]) | (parts // folds == 0)

    stat = lambda per: per.agg(*[F.round(a(c), 6).alias(f"{c}_{n}") for c in ("mae", "rmse") for a, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])
    if table is None:
        data, at = assembled(marked, len(names)).cache(), F.pmod("part", F.lit(folds))
        done = [ml_errors(data, ml_boosted(**settings), (at != f) & (F.floor(F.col("part") / folds) != 0), at == f) for f in range(folds)]
        data.unpersist()
        per = spark.createDataFrame([(e["mae"], e["rmse"]) for e, _ in done], "mae double, rmse double")
        return ranked(np.mean([w for _, w in done], axis=0).tolist(), names, spark), stat(per)
    found = fits(spark, table, [(f,) for f in range(folds)], held, lambda x, n, s, job: boosted(x, n, s, **settings))
    wide = errors(marked, table, pd.DataFrame(dict(enumerate(found["preds"]))), F.lit(True)).withColumn("f", F.pmod("part", F.lit(folds)))
    e = F.element_at("preds", F.col("f") + 1) - F.col("label")
    per = wide.groupBy("f").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    bounds = stat(per)
    return ranked(np.mean(found["importances"].tolist(), axis=0).tolist(), names, spark), bounds


def held_out_groups(rows: DataFrame, target: str, names: list[str], group: str, boundary: float = 0.25, trees: int = 100, depth: int = 5) -> DataFrame:
    """(group, n, actual_mean, predicted_mean, absolute_error, low, high, is_boundary): each group is predicted by a forest fitted on all others.

    The interval stands around twice the prediction less the actual mean, as errors are taken from it. Each group is one fit in a task of its own.
    """
    from quarry.operators.stats import t_quantile

    spark = rows.sparkSession
    marked, table = cells(rows, names, target, F.col(group))
    groups = sorted(table["part"].dropna().unique().tolist()) if table is not None else sorted(r[0] for r in marked.where("part IS NOT NULL").select("part").distinct().collect())
    empty = f"{group} string, n long, actual_mean double, predicted_mean double, absolute_error double, low double, high double, is_boundary boolean"
    if not groups:
        return spark.createDataFrame([], empty)

    if table is None:
        data = assembled(marked, len(names)).cache()
        own = F.col("part")
        stats = pd.DataFrame([{"part": g} | ml_errors(data, ml_forest(trees, depth), ~own.eqNullSafe(F.lit(g)), own == F.lit(g))[0] for g in groups])
        data.unpersist()
    else:
        held = lambda parts, job: parts == groups[job[0]]
        found = fits(spark, table, [(g,) for g in range(len(groups))], held, lambda x, n, s, job: forest(x, n, s, trees, depth))
        own = pd.DataFrame({"p": [found["preds"][groups.index(g)][i] if g in groups else 0.0 for i, g in enumerate(table["part"])]})
        wide = errors(marked, table, own, F.col("part").isNotNull())
        p = F.get("preds", F.lit(0))
        stats = wide.groupBy("part").agg(F.count("*").alias("n"), F.avg("label").alias("a"), F.avg(p).alias("p"), F.stddev_samp(p - F.col("label")).alias("s")).toPandas()
    out = []
    for r in stats.sort_values("part").itertuples():
        half = t_quantile(spark, 0.975, r.n - 1) * (r.s if r.s == r.s else 0.0) / r.n**0.5 if r.n > 1 else 0.0
        mid, gap = 2 * r.p - r.a, abs(r.a - r.p)
        out.append((str(r.part), int(r.n), *[round(float(v), 4) for v in (r.a, r.p, gap, mid - half, mid + half)], bool(gap > boundary)))
    return spark.createDataFrame(out, empty)
