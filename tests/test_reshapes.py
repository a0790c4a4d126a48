"""Curves, feature sets, dashboards' reshapes, saved tables and papers' files over odd tables."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.operators import collection, dashboard, evaluation, experiment, models, pipeline, stats
from quarry.schema import AS_OF
from quarry.sources import artifacts, feeds
from quarry.storage import new_path
from quarry.streaming.increment import read_stage


def test_decay_curves_do_not_hang_on_the_unit(spark):
    """Values of a known curve, in days and in thousandths: the same R2, and parameters in the unit of x."""
    rows = [("a", float(t), 0.2 + 0.7 * math.exp(-0.01 * t)) for t in range(0, 400, 3)] + [("b", float(t), 2.0 + 3 * t - 0.5 * t * t) for t in range(40)] + [("flat", 1.0, 5.0)] * 9 + [("few", 1.0, 1.0), ("a", None, 1.0), ("a", 1.0, float("nan")), (None, 1.0, 1.0), (None, 2.0, 3.0), (None, 3.0, 2.0), (None, 4.0, 1.0)]
    frame = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    fits = lambda scale: {(r["g"], r["curve"]): r for r in models.decay_fits(frame.withColumn("x", F.col("x") * scale), "g", "x", "y").collect()}
    one, small = fits(1.0), fits(1e-3)
    assert set(one) == set(small) == {(g, c) for g in ("a", "b", None) for c in ("polynomial", "exponential", "logistic")}
    assert all(one[k]["r2"] == pytest.approx(small[k]["r2"], abs=1e-3) for k in one)
    assert one["a", "exponential"]["params"] == pytest.approx([0.7, 0.01, 0.2], abs=1e-3) and one["a", "exponential"]["r2"] > 0.9999
    assert small["a", "exponential"]["params"] == pytest.approx([0.7, 10.0, 0.2], abs=1e-2)
    assert one["b", "polynomial"]["params"] == pytest.approx([-0.5, 3.0, 2.0], abs=1e-4) and one["b", "polynomial"]["r2"] == pytest.approx(1.0)
    assert models.decay_fits(frame.where("false"), "g", "x", "y").count() == 0


def test_feature_sets_and_fan_out(spark):
    frame = spark.createDataFrame([(float(i), float(i % 3), float(i % 2), 2.0 * i, None) for i in range(30)], "freshness_score double, source_diversity_index double, domain_volatility double, precision_at_5 double, human_eval_score double")
    frame = models.features(frame, squares=True)
    assert models.feature_set("precision_at_5", frame.columns) == models.BASE
    assert models.feature_set("human_eval_score", frame.columns) == [*models.BASE, *models.SQUARES]
    found = models.fan_out(frame, ["precision_at_5", "human_eval_score", "absent"], lambda r, t, names: models.ols(r, t, names))
    assert {r["target"] for r in found.collect()} == {"precision_at_5"}
    with pytest.raises(ValueError):
        models.fan_out(frame, ["absent"], None)


def test_plateau_limits(spark):
    rows = spark.createDataFrame([("technical", "technology", "", 1000), ("Technical", " history", None, 10), ("technical", None, None, 200), ("news", "history", "", 400), ("news", "x", "", 0), ("academic", "", "wikipedia", 225), ("academic", "", "arxiv", 1000), (None, None, None, 100)], "t string, d string, p string, n int")
    got = [r[0] for r in rows.select(collection.plateau_limit(F.col("t"), F.col("d"), F.col("p"), F.col("n"))).collect()]
    assert got == [12, 14, 8, 20, 8, 9, 20, 16]


def test_condition_queries(spark):
    bank = spark.createDataFrame([(1, "Technology "), (2, "history"), (3, "sports"), (4, None)], "query_id long, domain string")
    got = sorted((r["query_id"], r["condition_id"]) for r in experiment.condition_queries(bank).collect())
    assert got == sorted([(1, f"C{k}") for k in range(1, 7)] + [(2, f"C{k}") for k in (10, 11, 12)])


def test_dashboard_reshapes(spark):
    errors = spark.createDataFrame([("ols", "m", 0.3, 0.5), ("rf", "m", 0.2, None), ("xgb", "m", 0.2, None), ("rf", "only", 0.1, None), ("ols", "none", None, None), ("ols", None, 1.0, 1.0)], "model string, metric string, mae double, r2 double")
    got = {r["metric"]: r for r in dashboard.model_comparison(errors).collect()}
    assert (got["m"]["best_model"], got["m"]["best_mae"], got["m"]["ols_r2"]) == ("rf", 0.2, 0.5)
    assert (got["only"]["ols_mae"], got["only"]["best_model"]) == (0.0, "rf") and got["none"]["best_model"] is None and None not in got
    held = spark.createDataFrame([("m", "C1", "technology", True), ("m", "C2", "technology", False), ("m", "C10", "history", False)], "metric string, condition_id string, domain string, is_boundary boolean")
    assert {(r["domain"], r["boundary_conditions"], r["n"], r["reliable"]) for r in dashboard.validation_counts(held).collect()} == {("technology", 1, 2, False), ("history", 0, 1, True)}
    none = spark.createDataFrame([], "pair string, kappa double")
    one = dashboard.summary(errors.where("metric IS NOT NULL"), held, none).first()
    assert one["kappa"] is None and one["threshold_met"] is None and one["boundary_conditions"] == {"technology": 1} and one["metrics"]["none"]["mae"] == 0.0 and one["conditions"] == 3
    weights = spark.createDataFrame([("m", "rf", "b", 0.4), ("m", "rf", "a", 0.4), ("m", "rf", "c", None)], "metric string, model string, feature string, importance double")
    assert [(r["place"], r["feature"]) for r in dashboard.importances(weights).orderBy("place").collect()] == [(1, "a"), (2, "b")]
    path = new_path(spark, "h")
    spark.range(2).write.parquet(f"{path}/a")
    assert {(r["name"], r["present"]) for r in dashboard.health(spark, {"a": f"{path}/a", "b": f"{path}/b"}).collect()} == {("a", True), ("b", False)}


def test_one_way_fallback(spark):
    cells = spark.createDataFrame([("m", "x", "low", 5, 1.0, 1.0), ("m", "y", "low", 5, 2.0, 1.0)], "metric string, level string, volatility string, n long, mean double, std double")
    rows = stats.one_way_fallback(cells, ["metric"], ["level", "volatility"]).collect()
    assert [(r["factor"], r["k"], r["f"]) for r in rows] == [("level", 2, 2.5)]


def test_saved_tables_come_back(spark):
    base = new_path(spark, "saved")
    df = spark.createDataFrame([(1, 'a "quoted", line\nand more', ["x", "y"]), (2, None, [])], "n long, t string, tags array<string>")
    for end in (".json", ".csv", ""):
        artifacts.write_table(df.limit(0), f"{base}/t{end}")
        artifacts.write_table(df, f"{base}/t{end}")
        got = sorted(artifacts.read_table(spark, f"{base}/t{end}").select(F.col("n").cast("long").alias("n"), "t", "tags").collect())
        assert got[0]["t"] == 'a "quoted", line\nand more' and got[0]["tags"] in (["x", "y"], '["x","y"]') and len(got) == 2


def test_pdf_columns(spark):
    docs = spark.createDataFrame([("a", "https://arxiv.org/abs/2401.1/v2?x", None), ("b", "https://x.org", "https://arxiv.org/pdf/99.pdf"), ("c", None, " "), ("d d", "https://x.org", "https://host.org/file.pdf")], "id string, url string, pdf_url string")
    path = new_path(spark, "pdfs")
    spark.createDataFrame([("x",)], "value string").coalesce(1).write.text(f"{path}/folder")
    assert all(r["name"].startswith("part-") for r in feeds.folder_files(spark, f"{path}/folder/part-*").collect())
    present = spark.createDataFrame([("99.pdf",), ("99.pdf",)], "name string")
    got = {r["id"]: (r["pdf_url"], r["pdf_file_name"], r["pdf_available"]) for r in feeds.pdf_columns(docs, "c", present).collect()}
    assert got == {"a": ("https://arxiv.org/pdf/2401.1.pdf", "2401.1.pdf", False), "b": ("https://arxiv.org/pdf/99.pdf", "99.pdf", True), "c": (None, None, None), "d d": ("https://host.org/file.pdf", "d_d.pdf", False)}
    assert feeds.pdf_columns(docs, "c").where("pdf_available").count() == 0


def test_collection_in_one_plan(spark):
    body = "A language model systems paper about vector database software and algorithms. " * 6
    rows = [(i, f"id{i}", f"Title {i}", f"{body} number {i}", "arXiv", "academic", "technology", f"https://a.org/{i}", "2024-01-02", "en") for i in range(8)]
    rows += [(8, "id8", "Title 0", f"{body} number 0", "arXiv", "academic", "technology", "https://a.org/x", "2024-01-02", "en"), (9, "id9", "Title 9", f"{body} other", "arXiv", "academic", "technology", "https://A.org/1", "2024-01-02", "en"), (10, "id10", "Title", "short", "arXiv", "academic", "technology", "https://a.org/10", "2024-01-02", "en"), (11, "id11", "T", body, "arXiv", "academic", "technology", "https://a.org/11", None, "en")]
    raw = spark.createDataFrame(rows, "seq long, id string, title string, text string, source_name string, source_type string, domain string, url string, publication_date string, lang string").repartition(3)
    base = new_path(spark, "collection")
    counts = {r["stage"]: r["n"] for r in pipeline.collect(raw, base, AS_OF, {"technology": ["language model systems"]}, 5).collect()}
    assert (counts["raw"], counts["cleaned"], counts["deduplicated"], counts["dropped_duplicate_url"], counts["quality"], counts["final"]) == (12, 10, 9, 1, 8, 5)
    assert sorted(r["seq"] for r in read_stage(spark, base, "final").collect()) == [0, 1, 2, 3, 4]
    assert read_stage(spark, base, "cleaned").count() == 10


def test_experiment_tables(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, None), (3, None)], "query_id long, rouge double")
    measured = spark.createDataFrame([(1, 0.9, 1), (2, 0.7, 2)], "query_id long, rouge double, extra int")
    got = {r["query_id"]: (r["rouge"], r["extra"]) for r in experiment.write_back(rows, measured, ["query_id"], ["rouge", "extra"]).collect()}
    assert got == {1: (0.5, 1), 2: (0.7, 2), 3: (None, None)}
    sources = spark.createDataFrame([("a", s) for s in "xxyz"] + [("b", "x")] * 3 + [("c", None), ("c", "x")], "g string, s string")
    assert {r["g"]: r["sdi"] for r in experiment.diversity_index(sources, ["g"], "s").collect()} == {"a": 1.5, "b": 0.0, "c": 1.0}
    found = experiment.existence(rows, spark.createDataFrame([(2,), (2,), (9,)], "query_id long"), "query_id")
    assert {tuple(r) for r in found.collect()} == {(1, False, -1), (2, True, 2), (3, False, -1)}
    times = spark.createDataFrame([("b", 2.0), ("a", 1.0), ("a", 3.0), ("c", None)], "p string, t double")
    assert tuple(experiment.fastest(times.where("t IS NOT NULL"), "p", "t").first()) == ("a", 2.0)
    pairs = spark.createDataFrame([("C1", "the hospital treats patients daily.", "the hospital treats patients daily."), ("C1", None, "x")], "condition_id string, response string, reference string")
    m = sorted(experiment.response_metrics(pairs, ["condition_id"]).collect(), key=lambda r: r["meteor"])
    assert m[0]["meteor"] == 0 and m[1]["meteor"] > 0.9 and all(r["hallucination_rate"] == 0 for r in m)


def test_hallucination_rate_takes_whole_texts(spark):
    """A passage's words past its 800th character support a claim, and claims past the tenth count."""
    far = "x " * 500 + "the hospital treats patients daily."
    late = "The hospital treats patients daily. " * 10 + "Satellites orbit distant planets quietly."
    rows = [("C1", "The hospital treats patients daily.", far), ("C2", late, far), ("C3", None, far), ("C4", "The hospital treats patients daily.", None)]
    pairs = spark.createDataFrame(rows, "condition_id string, response string, reference string")
    got = {r["condition_id"]: r["hallucination_rate"] for r in experiment.response_metrics(pairs, ["condition_id"]).collect()}
    assert got == {"C1": 0.0, "C2": pytest.approx(1 / 11, abs=1e-6), "C3": 0.0, "C4": 1.0}
    passages = F.array("reference")
    cut = {r[0]: r[1] for r in pairs.select("condition_id", evaluation.hallucination_rate(F.col("response"), passages, most=10, chars=800)).collect()}
    assert (cut["C1"], cut["C2"]) == (1.0, 1.0)
