"""Edge rows of functions and operators, with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import dates, terms, text, urls, vectors
from quarry.operators import conditions, dedup, evaluation, keywords, quality, serving, stats


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def arr(*v):
    return F.array(*[F.lit(x) for x in v])


@pytest.mark.parametrize(
    "given, want",
    [
        ("HTTPS://WWW.Ex.org/A/?utm_source=x&b=2&a=&ref=q#z", "https://ex.org/A?b=2&a="),
        ("http://ex.org", "http://ex.org/"),
        ("https://ex.org/", "https://ex.org/"),
        ("", ""),
        (None, ""),
        ("No Host#x", "no host"),
    ],
)
def test_canonical_news_url(spark, given, want):
    assert one(spark, urls.canonical_news_url(F.lit(given).cast("string"))) == want


def test_ranking_metrics(spark):
    assert one(spark, vectors.precision(arr(1, 0, 1), 5)) == 0.666667
    assert one(spark, vectors.ndcg(arr(0, 1, 0, 0, 0), 5)) == 0.63093
    assert one(spark, vectors.ndcg(arr(0, 1, 1), 5)) == 0.693426
    assert one(spark, vectors.ndcg(arr(0, 0), 5)) == 0.0
    assert one(spark, vectors.precision(F.array().cast("array<int>"), 5)) == 0.0
    assert one(spark, vectors.entropy(arr("a", "a", "b"))) == 0.918296
    assert one(spark, vectors.entropy(arr("a", "a", "a", "b", "c"))) == 1.370951


@pytest.mark.parametrize("h, r, want", [("the cat sat", "the cat ran", 0.666667), ("", "x", 0.0), ("x", "", 0.0), ("a b c d", "b d", 0.666667)])
def test_rouge_l_both_forms(spark, h, r, want):
    row = spark.createDataFrame([(h, r)], "h string, r string")
    assert row.select(evaluation.rouge_l(F.col("h"), F.col("r")).alias("x")).first()["x"] == want
    assert evaluation.rouge_l_batches(row, "h", "r").first()["rouge_l"] == want


@pytest.mark.parametrize("h, r, want", [("alpha beta gamma delta", "alpha beta gamma delta", 0.9375), ("data data data", "data", 2.12963), ("cats running fast", "cat runs fast", 0.0), ("", "x", 0.0)])
def test_meteor_both_forms(spark, h, r, want):
    row = spark.createDataFrame([(h, r)], "h string, r string")
    assert row.select(evaluation.meteor(F.col("h"), F.col("r")).alias("x")).first()["x"] == pytest.approx(want, abs=2e-5)
    assert evaluation.meteor_batches(row, "h", "r").first()["meteor"] == pytest.approx(want, abs=2e-5)


def test_kappa(spark):
    k = lambda rows: evaluation.cohen_kappa(spark.createDataFrame(rows, "a int, b int"), "a", "b", [1, 2]).first()["kappa"]
    assert k([(1, 1), (1, 2), (2, 2), (2, 2)]) == 0.5
    assert k([(1, 1), (1, 1)]) is None


@pytest.mark.parametrize("score, want", [(2.5, 2), (3.5, 4), (0.4, 1), (5.6, 5)])
def test_adjudicated(spark, score, want):
    assert one(spark, evaluation.adjudicated(F.lit(score))) == want


def test_claims(spark):
    got = one(spark, text.claims(F.lit("Short. According to x it is so indeed. This one is long enough to keep.")))
    assert got == ["This one is long enough to keep."]


def test_words_and_terms(spark):
    assert one(spark, text.word_count(F.lit(""))) == 312
    assert one(spark, terms.domain_hits(F.lit("he said so"), F.lit("technology"))) == 1
    assert one(spark, terms.has_term(F.lit("publicly healthy"), "public health")) is False
    assert one(spark, text.stem(F.lit("running,"))) == "runn"


def test_freshness(spark):
    def score(age):
        s = dates.freshness_linear_volatility(F.lit(age).cast("double"), F.lit("technology"))
        return one(spark, F.struct(F.round(s, 4), dates.freshness_label(s)))

    assert tuple(score(60)) == (0.6667, "High") and tuple(score(180)) == (0.0, "Low") and tuple(score(None)) == (0.0, "Low")
    assert one(spark, dates.age_days(F.lit("2030-01-01"))) == 0.0 and one(spark, dates.age_days(F.lit("n.d."))) is None
    assert one(spark, F.round(dates.freshness_half_life(F.lit(14.0)), 4)) == 0.9475
    w = lambda age, d: one(spark, dates.freshness_window(F.lit(age).cast("double"), F.lit(d)))
    assert w(7.0, "technology") == "w1_under_1week" and w(7.01, "technology") == "w2_1week_1month"
    assert w(10, "healthcare") == "w1_1to6months" and w(None, "history") == "w4_archival" and w(None, "historical") == "w4_archival"


def test_adjusted_window(spark):
    inside = lambda age: one(spark, conditions.in_window(conditions.effective_age(F.lit(age), F.lit("history"), F.lit(">= 6 mo (adj.)")), F.lit(180), F.lit(None).cast("int")))
    assert not inside(8.87) and inside(8.88)


@pytest.mark.parametrize("order", [1, 7])
def test_quality_cascade(spark, order):
    long = "software data systems network cloud platform " * 6
    row = lambda s, url, t: (s, "title", t, url, "technology", "academic", "x", "2024-01-01")
    rows = [row(1, "http://a", long + "one"), row(2, "http://a", long + "two"), row(3, "", long + "two"), row(4, "", long + "two"), row(5, "", "short"), row(6, "", None)]
    d = spark.createDataFrame(rows, "seq long, title string, text string, url string, domain string, source_type string, source_name string, publication_date string").repartition(order)
    got = {r["seq"]: r["reason"] for r in quality.quality_reasons(d).collect()}
    assert got == {1: None, 2: "dropped_duplicate_url", 3: None, 4: "dropped_duplicate_content", 5: "dropped_short_text", 6: "dropped_empty_title_or_text"}
    assert {r["seq"] for r in quality.quality_filter(d).collect()} == {1, 3}


def test_greedy_leader(spark):
    at = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg))]
    v = spark.createDataFrame([(1, at(0)), (2, at(10)), (3, at(20)), (4, at(90)), (5, at(91)), (6, [0.0, 0.0])], "seq long, vec array<double>")
    got = {r["seq"]: r["kept"] for r in dedup.greedy_leader(v, 0.98).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True}


def test_anova_golden(spark):
    """Two groups with known statistics: F, effect and tail."""
    cells = spark.createDataFrame([("m", 1, 5, 1.0, 1.0), ("m", 2, 5, 3.0, 1.0)], "metric string, level int, n long, mean double, std double")
    r = stats.with_p(stats.one_way(cells, ["metric"], "level"), ["metric"]).first()
    assert r["f"] == 10.0 and r["eta_squared"] == pytest.approx(10 / 18, abs=1e-6) and r["p"] == pytest.approx(0.013343, abs=1e-5)
    assert stats.pairwise(cells, ["metric"], "level").first()["cohens_d"] == -2.0
    assert stats.f_tail(spark, 2.552675, 2, 2397) == pytest.approx(0.078085, abs=1e-6)
    assert stats.studentized_range_tail(3.77, 3, 12) == pytest.approx(0.05, abs=2e-3)


def test_serving(spark):
    assert one(spark, serving.cadence(F.lit(0.75))) == "Weekly" and one(spark, serving.cadence(F.lit(0.0))) == "Quarterly"
    tiers = spark.createDataFrame([("d", 0, 0.0, 0.2), ("d", 1, 0.2, 0.4), ("d", 2, 0.3, 0.3)], "domain string, tier int, tier_sdi double, p double")
    s = serving.tier_summary(tiers, "p").first()
    assert (s["best_tier"], s["worst_tier"], s["delta_pct"], s["pollution"]) == (1, 0, 100.0, True)


def test_keywords(spark):
    rows = spark.createDataFrame([(["AI", "ai ", ""], "technology", "news", 0)], "base array<string>, domain string, kind string, round int")
    rows = rows.withColumns({"short": arr("today"), "long": arr("weekly roundup report"), "queries": arr("q")})
    got = keywords.expand(rows).first()["expanded"]
    assert len(got) == len({g.lower() for g in got}) >= 250 and "technology research" in got
    assert one(spark, keywords.strict_floor(F.lit(1000))) == 400
