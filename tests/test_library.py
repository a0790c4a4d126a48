"""Operators without SQL against plain versions, and the forms that write tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import collection, dedup, models, retrieval, stats
from quarry.sources import feeds
from quarry.storage import new_path
from quarry.streaming import increment


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = 1.5 + x @ [2.0, -1.0, 0.0] + rng.normal(size=400) * 0.3
    return x, y, spark.createDataFrame([(i, *map(float, r), float(v), "abc"[i % 3]) for i, (r, v) in enumerate(zip(x, y))], "key long, a double, b double, c double, y double, g string")


def test_ols_equals_numpy(spark, rows):
    x, y, df = rows
    got = {r["feature"]: r for r in models.ols(df, "y", ["a", "b", "c"]).collect()}
    m = np.column_stack((np.ones(400), x))
    beta, *_ = np.linalg.lstsq(m, y, rcond=None)
    left = y - m @ beta
    s2 = left @ left / 396
    se = np.sqrt(s2 * np.diag(np.linalg.inv(m.T @ m)))
    r2 = 1 - left @ left / ((y - y.mean()) @ (y - y.mean()))
    for k, name in enumerate(["intercept", "a", "b", "c"]):
        assert got[name]["coef"] == pytest.approx(beta[k], abs=2e-6) and got[name]["std_err"] == pytest.approx(se[k], abs=2e-6)
    assert got["a"]["r2"] == pytest.approx(r2, abs=2e-6) and got["a"]["f"] == pytest.approx(r2 / 3 / ((1 - r2) / 396), rel=1e-5)
    assert got["a"]["p"] == 0 and got["c"]["p"] > 0.01 and got["a"]["n"] == 400
    found = {r["feature"]: r["coef"] for r in models.moderated(df, "y", "a", "b").collect()}
    m = np.column_stack((np.ones(400), x[:, 0], x[:, 1], x[:, 0] * x[:, 1]))
    assert [found[f] for f in ("intercept", "a", "b", "a_x_b")] == pytest.approx(np.linalg.lstsq(m, y, rcond=None)[0].tolist(), abs=2e-6)


def test_cross_validation_equals_fold_by_fold(spark, rows):
    x, y, df = rows
    fold = np.array([r["f"] for r in df.orderBy("key").select(models.fold(F.col("key"), 5).alias("f")).collect()])
    mae = []
    m = np.column_stack((np.ones(400), x))
    for k in range(5):
        beta, *_ = np.linalg.lstsq(m[fold != k], y[fold != k], rcond=None)
        mae.append(np.abs(y[fold == k] - m[fold == k] @ beta).mean())
    got = models.ols_cv(df, "y", ["a", "b", "c"], "key", 5).first()
    assert got["mae_mean"] == pytest.approx(np.mean(mae), abs=2e-6) and got["mae_std"] == pytest.approx(np.std(mae), abs=2e-6)


def test_decay_curves_are_found(spark):
    t = np.linspace(0, 3, 40)
    curves = {"polynomial": 1 - 0.5 * t + 0.1 * t * t, "exponential": 0.8 * np.exp(-1.3 * t) + 0.1, "logistic": 0.9 / (1 + np.exp(2.0 * (t - 1.5)))}
    df = spark.createDataFrame([(g, float(a), float(b)) for g, v in curves.items() for a, b in zip(t, v)], "g string, x double, y double")
    for r in models.decay_fits(df, "g", "x", "y").collect():
        if r["g"] == r["curve"]:
            assert r["r2"] > 0.9999


def test_anova_p_against_the_beta_integral(spark):
    """P of F by numeric integration of its density."""
    from math import lgamma

    df = spark.createDataFrame([("m", g, float(v)) for g, vs in {"a": [1, 2, 3, 4], "b": [2, 3, 4, 6], "c": [5, 6, 5, 8]}.items() for v in vs], "metric string, level string, v double")
    cells = df.groupBy("metric", "level").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    r = stats.with_p(stats.one_way(cells, ["metric"], "level"), ["metric"]).first()
    f, d1, d2 = r["f"], 2, 9
    t = np.linspace(f, f + 4000, 4_000_001)
    log = lgamma((d1 + d2) / 2) - lgamma(d1 / 2) - lgamma(d2 / 2) + d1 / 2 * np.log(d1 / d2)
    density = np.exp(log + (d1 / 2 - 1) * np.log(t) - (d1 + d2) / 2 * np.log1p(d1 * t / d2))
    assert r["p"] == pytest.approx(np.trapezoid(density, t), abs=1e-4)


@pytest.mark.parametrize("shard", [1, 1 << 20])
def test_top_k_equals_brute_force(spark, shard):
    rng = np.random.default_rng(2)
    v = rng.integers(-2, 3, (200, 4)).astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, [1.0] * 4), (900, None), (901, [1.0, None, 1.0, 1.0])]
    index = spark.createDataFrame(rows, "id long, v array<double>")
    got = retrieval.top_k(index, index.where("id % 20 = 0").select(F.col("id").alias("q"), F.col("v").alias("w")), 5, "id", "v", "q", "w", shard_bytes=shard).collect()
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    sims = np.round(unit @ unit.T, 6)
    for q in range(0, 200, 20):
        want = sorted(range(200), key=lambda i: (-sims[q, i], i))[:5]
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["q"] == q] == want
    assert retrieval.top_k(index.where("false"), index.select(F.col("id").alias("q"), F.col("v").alias("w")), 5, "id", "v", "q", "w").count() == 0


def test_stages_and_admission(spark):
    base = new_path(spark, "stages")
    docs = spark.createDataFrame([("technology", "news", 1), ("history", "news", 2)], "domain string, source_type string, n int")
    increment.save_stage(docs, base, "raw")
    increment.save_stage(docs.where("domain = 'history'").withColumn("n", F.lit(5)), base, "raw")
    assert sorted(r["n"] for r in increment.read_stage(spark, base, "raw").collect()) == [1, 5]
    with pytest.raises(ValueError):
        increment.save_stage(docs, base, "other")
    kind = "seq long, id string, url string, title string, publication_date string, text string, domain string, source_type string, source_name string"
    row = lambda n, u: (n, u, u, f"t{u}", "2024-01-01", "x", "history", "news", "s")
    place, table = new_path(spark, "arrivals"), new_path(spark, "admitted")
    for part in ([row(1, "a"), row(2, "b")], [row(3, "b"), row(4, "c")]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(place)
        increment.admit(spark, place, spark.createDataFrame(part, kind).schema, table, f"{table}-checkpoint")
    assert sorted(r["seq"] for r in spark.read.parquet(table).collect()) == [1, 2, 4]


def test_tolerant_json_and_policies(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, 5, {"a": 2}]')
    (tmp_path / "b.json").write_text("no json at all")
    got = feeds.json_rows(spark, str(tmp_path), "a int")
    assert sorted(r["a"] for r in got.collect()) == [1, 2]
    assert feeds.json_rows(spark, str(tmp_path / "none.json"), "a int").count() == 0
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "o")], [(1, "n"), (2, "n")]))
    done = lambda policy, target=9: sorted(map(tuple, collection.existing_policy(old, new, "k", policy, target).collect()))
    assert done("skip") == done("auto", 1) == [(1, "o")] and done("recreate") == [(1, "n"), (2, "n")] and done("fill") == done("auto") == [(1, "o"), (2, "n")]


def test_collection_ends_at_a_plateau(spark):
    arrivals = spark.createDataFrame([(r, 10 * r + s, k) for r, ks in enumerate(["ab", "bc", "a", "c", "de"]) for s, k in enumerate(ks)], "round int, seq long, key string")
    got = [r["key"] for r in collection.collect_rounds(arrivals, 100, 2).orderBy("place").collect()]
    assert got == ["a", "b", "c"]
    assert [r["key"] for r in collection.collect_rounds(arrivals, 1, 9).orderBy("place").collect()] == ["a", "b"]


@pytest.mark.parametrize("block", [1 << 20, 800])
def test_greedy_leader_equals_a_loop(spark, block):
    rng = np.random.default_rng(6)
    v = rng.integers(-2, 3, (150, 4)).astype(float)
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    kept = []
    for i in range(150):
        if all(unit[k] @ unit[i] < 0.9 for k in kept):
            kept.append(i)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [None, 1.0, 1.0, 1.0])], "seq long, vec array<double>")
    got = {r["seq"]: r["kept"] for r in dedup.greedy_leader(df.repartition(3), 0.9, block_bytes=block).collect()}
    assert sorted(k for k, x in got.items() if x) == kept + [900, 901] and len(got) == 152
    assert dedup.greedy_leader(df.where("false"), 0.9).count() == 0
