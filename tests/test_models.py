"""Trees over cells against plain searches; the registered model queries fit with full sizes."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry import plans
from quarry.operators import models, stats, trees

SF = "/root/testdata/sf0.001"


def _every(count):
    return np.ones((count, 3), bool)


def _plain(x, g, h, depth, least_split, least_leaf):
    """A tree by recursion over all splits of a node; returns the value by row."""
    out = np.zeros(len(g))

    def strength(m):
        return g[m].sum() ** 2 / h[m].sum() if h[m].sum() > 0 else 0.0

    def node(m, level):
        best, found = 1e-9, None
        if (depth is None or level < depth) and h[m].sum() >= least_split:
            for f in range(x.shape[1]):
                for cut in range(x[:, f].max()):
                    a, b = m & (x[:, f] <= cut), m & (x[:, f] > cut)
                    if min(h[a].sum(), h[b].sum()) >= least_leaf:
                        won = strength(a) + strength(b) - strength(m)
                        if won > best + 1e-12:
                            best, found = won, (a, b)
        if found:
            node(found[0], level + 1)
            node(found[1], level + 1)
        elif h[m].sum() > 0:
            out[m] = -g[m].sum() / h[m].sum()

    node(np.ones(len(g), bool), 0)
    return out


@pytest.mark.parametrize("depth, least_split, least_leaf", [(None, 2, 1), (3, 2, 1), (2, 6, 3), (None, 2, 4)])
def test_trees_equal_a_plain_search(depth, least_split, least_leaf):
    rng = np.random.default_rng(depth or 9)
    for _ in range(10):
        x = rng.integers(0, 6, (40, 3))
        h = rng.integers(0, 4, 40).astype(float)
        g = rng.normal(size=40) * h
        value, gain, splits = trees.grow(x, g, h, depth, least_split, least_leaf, 0.0, 0.0, _every)
        assert np.allclose(value[h > 0], _plain(x, g, h, depth, least_split, least_leaf)[h > 0])
        assert (gain >= 0).all() and splits.sum() >= 1


def test_forest_and_boosting_find_the_feature():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 16, (400, 3))
    n = rng.integers(1, 5, 400).astype(float)
    s = n * (x[:, 1] / 16 + 0.01 * rng.normal(size=400))
    for preds, weight in (trees.forest(x, n, s, 30), trees.boosted(x, n, s, 60, 0.2)):
        assert weight.argmax() == 1 and weight.sum() == pytest.approx(1)
        assert np.abs(preds - s / n).mean() < 0.05


def test_search_takes_errors_over_held_out_rows(spark):
    rows = spark.range(900).select(F.col("id").alias("key"), (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    rows = rows.withColumn("y", F.col("a") * 2).union(spark.createDataFrame([(-1, None, 1.0, 5.0), (-2, 1.0, 1.0, None)], "key long, a double, b double, y double"))
    weight, bounds = trees.forest_search(rows, "y", ["a", "b"], "key", {"depth": [1, 8], "least_leaf": [1]}, 20, 2, 3)
    r = bounds.first()
    assert r["parameters"].startswith("depth=8") and r["n"] == 900 and r["mae_mean"] < 0.2 and r["r2_mean"] > 0.95
    assert weight.first()["feature"] == "a"
    groups = trees.held_out_groups(rows.where("a IS NOT NULL").withColumn("g", F.when(F.col("b") < 3, "x").otherwise("y")), "y", ["a", "b"], "g", trees=20, depth=8)
    assert [r["g"] for r in groups.collect()] == ["x", "y"] and all(r["absolute_error"] < 0.25 for r in groups.collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_model_queries_fit_with_full_sizes(spark, monkeypatch):
    jobs, sizes = [], []
    monkeypatch.setattr(trees, "forest", lambda x, n, s, count, *a, **b: sizes.append(count) or (n * 0.0, np.zeros(x.shape[1])))
    monkeypatch.setattr(trees, "boosted", lambda x, n, s, rounds=300, **b: sizes.append(rounds) or (n * 0.0, np.zeros(x.shape[1])))

    def fits(spark, table, asked, held, fit):
        jobs.append(len(asked))
        x = table[[c for c in table.columns if c.startswith("b")]].to_numpy()
        done = [fit(x, table["n"].to_numpy(float), table["s"].to_numpy(float), j) for j in asked[:1]] * len(asked)
        return pd.DataFrame({"job": range(len(asked)), "preds": [p.tolist() for p, _ in done], "importances": [w.tolist() for _, w in done]})

    monkeypatch.setattr(trees, "fits", fits)
    for name in ("q147_small_forest", "q148_forest", "q149_boosted", "q151_held_out_groups"):
        plans.QUERIES[name](spark, SF).collect()
    # grid times folds, the best one's folds, the last fit
    assert jobs == [36, 10, 1, 60, 10, 1, 10, 3]
    assert sizes == [500] * 6 + [300, 100]


def test_many_cells_keep_every_row(spark, monkeypatch):
    """More cells than a table may have: the fits are those of pyspark.ml over all rows, at the same bins."""
    n = F.col("id")
    names = [f"x{k}" for k in range(14)]
    wide = spark.range(120_000, numPartitions=4).select(n.alias("key"), *[(F.pmod(F.xxhash64(F.lit(k), n), F.lit(40)) / 40).alias(f"x{k}") for k in range(14)])
    wide = wide.withColumn("y", F.col("x3") * 2).withColumn("g", F.when(F.col("key") % 3 == 0, "p").otherwise("q"))
    marked, table = trees.cells(wide, names, "y", F.col("g"))
    assert table["n"].sum() == 120_000 and marked.agg(F.countDistinct("b3")).first()[0] == 40
    monkeypatch.setattr(trees, "MAX_CELLS", 1 << 16)
    marked, table = trees.cells(wide, names, "y", F.col("g"))
    assert table is None and marked.count() == 120_000 and marked.agg(F.countDistinct("b3")).first()[0] == 40
    groups = {r["g"]: r for r in trees.held_out_groups(wide, "y", names, "g", trees=2, depth=6).collect()}
    assert (groups["p"]["n"], groups["q"]["n"]) == (40_000, 80_000) and all(r["absolute_error"] < 0.1 for r in groups.values())
    # the searches give the same answers either way
    rows = spark.range(900).select(n.alias("key"), (n % 10).cast("double").alias("a"), (n % 7).cast("double").alias("b")).withColumn("y", F.col("a") * 2)
    search = lambda: trees.forest_search(rows, "y", ["a", "b"], "key", {"depth": [1, 8], "least_leaf": [1], "features": [None]}, 20, 2, 3)
    boost = lambda: trees.boosted_search(rows, "y", ["a", "b"], "key", 2, rounds=20, rate=0.3)
    for found in (search, boost):
        one = found()
        with monkeypatch.context() as m:
            m.setattr(trees, "MAX_CELLS", 5)
            other = found()
        for weight, bounds in (one, other):
            assert weight.first()["feature"] == "a" and bounds.first()["mae_mean"] < 0.5
    assert other[0].count() == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_registered_model_queries_fit(spark):
    """The boosted query and the held-out groups as they are registered, fitted for real."""
    rows = plans.QUERIES["q149_boosted"](spark, SF).collect()
    assert len(rows) == 6 and sum(r["importance"] for r in rows) == pytest.approx(1, abs=1e-4) and 0 < rows[0]["mae_mean"] < 0.3
    groups = plans.QUERIES["q151_held_out_groups"](spark, SF).collect()
    assert len(groups) == 3 and sum(r["n"] for r in groups) == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_moderated_regression_and_two_way_tests_equal_numpy(spark):
    """The moderated form against least squares over rows; type III tests of an unbalanced table with a missing cell against residual sums of rows."""
    rng = np.random.default_rng(9)
    x, m = rng.normal(size=300), rng.integers(0, 3, 300) / 2
    y = 1 + 2 * x - 0.5 * m + 0.7 * x * m + 0.1 * rng.normal(size=300)
    frame = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, m, y)], "x double, m double, y double")
    got = {r["feature"]: r for r in models.moderated(frame, "y", "x", "m").collect()}
    full = np.stack([np.ones(300), x, m, x * m], 1)
    beta, rss, _, _ = np.linalg.lstsq(full, y, rcond=None)
    assert [got[k]["coef"] for k in ("intercept", "x", "m", "x_x_m")] == pytest.approx(beta.tolist(), abs=1e-5)
    assert got["x"]["r2"] == pytest.approx(1 - float(rss[0]) / ((y - y.mean()) ** 2).sum(), abs=1e-5)
    # rows of five of six cells
    rows = [(a, b, float(rng.normal() + a * 2 + b)) for a in range(2) for b in range(3) if (a, b) != (1, 2) for _ in range(5 + 3 * a + b)]
    cells = spark.createDataFrame([(*r, "t") for r in rows], "a int, b int, y double, test string").groupBy("test", "a", "b").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"))
    found = {r["term"]: r for r in stats.two_way(cells, "test", "a", "b").collect()}
    a, b, v = (np.array(c, float) for c in zip(*rows))
    da, db = a == 1, [b == k for k in (1, 2)]
    whole = np.stack([np.ones(len(v)), da, *db, *[da & d for d in db]], 1).astype(float)
    rank = np.linalg.matrix_rank
    res = lambda z: float(((v - z @ np.linalg.lstsq(z, v, rcond=None)[0]) ** 2).sum())
    for term, drop in (("a", [1]), ("b", [2, 3]), ("a:b", [4, 5])):
        less = np.delete(whole, drop, axis=1)
        df = rank(whole) - rank(less)
        f = (res(less) - res(whole)) / df / (res(whole) / (len(v) - rank(whole)))
        assert found[term]["df"] == df and found[term]["f"] == pytest.approx(f, abs=2e-3)
