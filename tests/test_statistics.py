"""Post-hoc intervals, normality and order statistics against published values and plain versions; requests, questions and chart frames."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quarry.operators import charts, order, questions, serving, stats


@pytest.mark.parametrize("p,k,df,q", [(0.05, 3, 10, 3.877), (0.05, 4, 20, 3.958), (0.01, 3, 10, 5.270), (0.05, 10, 30, 4.824), (0.05, 2, 60, 2.829), (0.05, 5, 120, 3.917)])
def test_studentized_range_quantiles_equal_published_tables(p, k, df, q):
    assert stats.studentized_range_quantile(p, k, df) == pytest.approx(q, abs=0.003)
    assert stats.studentized_range_tail(stats.studentized_range_quantile(p, k, df), k, df) == pytest.approx(p, abs=1e-6)


def test_tukey_intervals(spark):
    """Equal counts by hand: half-widths are q times the root of the error over n; the interval leaves out 0 where the test rejects."""
    cells = spark.createDataFrame([("m", "a", 11, 10.0, 2.0), ("m", "b", 11, 12.5, 2.0), ("m", "c", 11, 10.5, 2.0), ("one", "a", 5, 1.0, 1.0), ("flat", "a", 5, 1.0, 0.0), ("flat", "b", 5, 2.0, 0.0)], "metric string, level string, n long, mean double, std double")
    rows = {(r["group1"], r["group2"]): r for r in stats.tukey(cells, "metric", "level").collect()}
    assert set(rows) == {("a", "b"), ("a", "c"), ("b", "c")}
    half = 3.486 * math.sqrt(4 / 11)
    r = rows["a", "b"]
    assert (r["low"], r["high"]) == (pytest.approx(2.5 - half, abs=0.003), pytest.approx(2.5 + half, abs=0.003))
    assert r["cohens_d"] == -1.25 and r["bonferroni_alpha"] == pytest.approx(0.05 / 3, abs=1e-6) and r["metric"] == "m"
    assert all((x["low"] > 0 or x["high"] < 0) == x["reject"] for x in rows.values()) and rows["a", "b"]["reject"] and not rows["a", "c"]["reject"]
    assert stats.tukey(cells.where("false"), "metric", "level").count() == 0


def test_shapiro_wilk_equals_published_examples(spark):
    """Weights of eleven men (Shapiro and Wilk 1965); three values and a long tail by the reference implementation."""
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    rows = [("men", float(x)) for x in men] + [("three", x) for x in (1.0, 2.0, 4.0)] + [("two", 1.0), ("two", 2.0)] + [("same", 3.0)] * 9 + [(None, float(x)) for x in men] + [("men", None), ("men", float("nan"))]
    got = {r["g"]: r for r in stats.shapiro_wilk(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect()}
    assert got["men"]["w"] == pytest.approx(0.78881, abs=2e-5) and got["men"]["p"] == pytest.approx(0.006704, abs=5e-6) and got["men"]["n"] == 11 and got["men"]["normal"] is False
    assert got[None]["w"] == got["men"]["w"]
    assert got["three"]["w"] == pytest.approx(0.964286, abs=1e-6) and got["three"]["p"] == pytest.approx(0.636886, abs=1e-4)
    assert all(got[g][c] is None for g in ("two", "same") for c in ("w", "p", "normal"))
    assert stats.shapiro_wilk(spark.createDataFrame([], "g string, x double"), ["g"], "x").count() == 0


def test_shapiro_wilk_of_ties_and_whole_tables(spark, monkeypatch):
    """Runs of equal values dealt over several spans give what single ranks give."""
    rng = random.Random(4)
    values = [round(rng.gauss(5, 2)) for _ in range(900)]
    frame = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(5)
    whole = stats.shapiro_wilk(frame, [], "x").first()
    monkeypatch.setattr(stats, "RANKS", 7)
    assert stats.shapiro_wilk(frame, [], "x").first() == whole
    norm = [statistics.NormalDist().inv_cdf((i + 1 - 0.375) / 900.25) for i in range(900)]
    mm = sum(m * m for m in norm)
    an, an1, root = stats.shapiro_coefficients(900, mm, norm[-1], norm[-2])
    a = [-an, -an1, *[m / root for m in norm[2:-2]], an1, an]
    mean = statistics.fmean(values)
    assert whole["w"] == pytest.approx(sum(x * y for x, y in zip(a, sorted(values))) ** 2 / sum((v - mean) ** 2 for v in values), abs=1e-6)


def test_medians_and_positions(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice([1.0, 2.0, 7.5]) if rng.random() < 0.5 else rng.random()) for _ in range(501)] + [("c", 4.0), (None, 2.0), (None, 3.0), ("c", None)]
    frame = spark.createDataFrame(rows, "g string, x double").repartition(6)
    got = {r["g"]: (r["n"], r["median"]) for r in order.medians(frame, ["g"], "x").collect()}
    groups = {g: [x for h, x in rows if h == g and x is not None] for g in ("a", "b", "c", None)}
    assert got == {g: (len(v), statistics.median(v)) for g, v in groups.items()}
    assert order.medians(frame, [], "x").first()["median"] == statistics.median([x for v in groups.values() for x in v])
    numbered = spark.createDataFrame([(g, i) for i, (g, _) in enumerate(rows)], "g string, i long").repartition(4)
    placed = order.positions(numbered, ["g"], ["i"]).collect()
    for g in groups:
        own = [i for i, (h, _) in enumerate(rows) if h == g]
        assert sorted((r["i"], r["position"], r["position_of"]) for r in placed if r["g"] == g) == [(x, k, len(own)) for k, x in enumerate(own)]


def test_homogeneity(spark):
    rng = random.Random(6)
    rows = [("even", g, rng.gauss(0, 1)) for g in "xyz" for _ in range(40)] + [("odd", g, rng.gauss(0, s)) for g, s in (("x", 1), ("y", 9)) for _ in range(40)] + [("odd", "z", 1.0), ("single", "x", 1.0), ("single", "x", 3.0)]
    got = {r["t"]: r for r in stats.homogeneity(spark.createDataFrame(rows, "t string, g string, x double"), ["t"], "g", "x").collect()}
    assert got["even"]["homogeneous"] is True and got["odd"]["homogeneous"] is False and got["odd"]["k"] == 2
    assert got["single"]["f"] is None and got["single"]["p"] is None and got["single"]["homogeneous"] is None


COEF = [("precision_at_5", "intercept", 0.2), ("precision_at_5", "freshness_score", 0.3), ("hallucination_rate", "intercept", 0.4), ("hallucination_rate", "source_diversity_index", 0.1)]


def test_bad_requests_are_rows(spark):
    rows = [("ok", "technology", "180", "full", None), ("given", " Healthcare ", None, None, "0.25"), ("domain", "sports", "3", "full", "0.1"), ("age", "history", "-1", "academic", None), ("text", "history", "old", "academic", "x"), ("nan", "history", "NaN", None, "Infinity"), ("null", None, "", "", "")]
    requests = spark.createDataFrame(rows, "request_id string, domain string, avg_age_days string, source_config string, sdi string")
    tiers = spark.createDataFrame([("technology", 0, 0.1, 0.5), ("technology", 1, 0.4, 0.6), ("healthcare", 0, 0.2, 0.3)], "domain string, tier int, tier_sdi double, precision_at_5 double")
    coef, mae = spark.createDataFrame(COEF, "metric string, feature string, coef double"), spark.createDataFrame([("precision_at_5", 0.1), ("hallucination_rate", 0.2)], "metric string, mae double")
    got = {r["request_id"]: r for r in serving.batch_predict(requests, coef, mae, tiers).collect()}
    assert set(got) == {r[0] for r in rows}
    errors = {k: [(e["field"], e["type"]) for e in r["errors"]] for k, r in got.items()}
    assert errors == {"ok": [], "given": [], "domain": [("domain", "unknown")], "age": [("avg_age_days", "negative")], "text": [("avg_age_days", "not a number"), ("sdi", "not a number")], "nan": [("avg_age_days", "not a number"), ("sdi", "not a number")], "null": [("domain", "unknown")]}
    assert got["domain"]["errors"][0]["message"] == "Invalid domain 'sports'. Use technology, healthcare, or history."
    assert got["domain"]["predictions"] is None and got["null"]["domain"] is None
    ok = got["ok"]
    assert (ok["sdi"], ok["freshness_score"], ok["source_level"], ok["avg_age_days"]) == (0.4, 0.5, "Two-Source Mix", 180.0)
    assert ok["predictions"]["precision_at_5"]["expected"] == 0.35 and ok["predictions"]["hallucination_rate"]["upper"] == 0.64
    assert got["given"]["sdi"] == 0.25 and got["given"]["avg_age_days"] == 30.0 and got["given"]["source_config"] == "academic" and got["given"]["warnings"] == []
    assert serving.batch_predict(requests.where("false"), coef, mae, tiers).count() == 0


def test_question_documents(spark):
    docs = [(("d", "e", "f")[i % 3] if i < 12 else "g", f"id{i}", f"t{i}", "x" * 2000, "s", "news", f"u{i}", None) for i in range(13)] + [(None, "id99", "t", "x", "s", "news", "u", None)]
    frame = spark.createDataFrame(docs, "domain string, id string, title string, text string, source_name string, source_type string, url string, publication_date string").repartition(3)
    assert questions.quotas(10) == {"factual": 4, "analytical": 3, "comparative": 3}
    rows = questions.question_documents(frame, 10).collect()
    assert sorted({r["domain"] for r in rows}) == ["d", "e", "f"] and len(rows) == 30
    own = sorted((r for r in rows if r["domain"] == "d"), key=lambda r: r["query_id"][-4:])
    assert [r["query_id"] for r in own][:5] == ["d_factual_0001", "d_factual_0002", "d_factual_0003", "d_factual_0004", "d_analytical_0005"]
    dealt = [i for r in own for i in r["source_doc_ids"]]
    # four documents, sixteen turns: each four times, and none twice within a round
    assert len(dealt) == 16 and all(sorted(dealt[a : a + 4]) == ["id0", "id3", "id6", "id9"] for a in range(0, 16, 4)) and dealt[:4] == dealt[4:8]
    assert len(own[0]["text1"]) == 1000 and own[0]["text2"] is None and len(own[4]["text2"]) == 700 and own[0]["date1"] == ""
    again = questions.question_documents(frame.repartition(7), 10).collect()
    assert sorted(again, key=str) == sorted(rows, key=str)
    assert sorted(questions.question_documents(frame, 10, seed=1).collect(), key=str) != sorted(rows, key=str)
    assert questions.question_documents(frame.where("false"), 10).count() == 0 and questions.question_documents(frame, 0).count() == 0


def test_chart_frames(spark):
    rows = spark.createDataFrame([("C1", "d", 1, 0.5), ("C1", "d", 2, 1.0), ("C2", "d", 1, None), ("C3", None, 2, 0.25)], "condition string, domain string, bin int, m double")
    wanted = {"bars": ["condition"], "domains": ["domain"], "heat": ["domain", "bin"], "again": ["condition"]}
    got = {(r["chart"], r["condition"], r["domain"], r["bin"]): (r["n"], r["m"], r["m_n"]) for r in charts.chart_frames(rows, wanted, ["m"]).collect()}
    bars = {("C1", None, None): (2, 0.75, 2), ("C2", None, None): (1, None, 0), ("C3", None, None): (1, 0.25, 1)}
    assert got == {(c, *k): v for c in ("bars", "again") for k, v in bars.items()} | {("domains", None, "d", None): (3, 0.75, 2), ("heat", None, "d", 1): (2, 0.5, 1), ("heat", None, "d", 2): (1, 1.0, 1)}
    heat = charts.heat_map(charts.chart_frames(rows, wanted, ["m"]), "heat", "domain", "bin", [1, 2, 3], "m").collect()
    assert [tuple(r) for r in heat] == [("d", 0.5, 1.0, None)]
    bins = rows.select(charts.bin_of(F.col("m"), 0.0, 1.0, 4).alias("b")).collect()
    assert [r["b"] for r in bins] == [2, 3, None, 1]


def test_f_distribution_without_the_jvm(spark):
    for f in (0.0, 0.01, 0.5, 1.0, 2.552675, 7.3, 80.0):
        for d1, d2 in ((1, 1), (2, 2397), (3, 10), (40, 7), (1, 300000)):
            assert stats.f_exceeds(f, d1, d2) == pytest.approx(stats.f_tail(spark, f, d1, d2), abs=1e-9)
    assert math.isnan(stats.f_exceeds(1.0, 0, 5)) and stats.f_exceeds(2.552675, 2, 2397) == pytest.approx(0.0780848, abs=1e-6)
