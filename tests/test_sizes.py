"""Plans and state that must not grow with the wrong side of a job."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry import plans
from quarry.operators import serving

SF = "/root/testdata/sf0.001"


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q153_predict", "q160_readiness", "q161_recommendations", "q154_batch_predict"])
def test_requests_are_not_broadcast(spark, name):
    plan = executed(plans.QUERIES[name](spark, SF))
    # what is broadcast comes from coefficients, bounds and suppliers; requests come from orders
    broadcast, depth = [], None
    for line in plan.splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at <= depth:
            depth = None
        if "BroadcastExchange" in line:
            depth = at
        if depth is not None:
            broadcast.append(line)
    assert broadcast and not any("o_orderkey" in x or "request_id" in x for x in broadcast)


def test_predictions_of_repeated_ids_and_missing_values(spark):
    requests = spark.createDataFrame([(1, "history", 0.0, 0.5), (1, "history", 0.0, 0.25), (2, "history", 0.0, None), (3, None, None, None)], "request_id long, domain string, avg_age_days double, sdi double")
    coefficients = spark.createDataFrame([("m", "intercept", 0.125), ("m", "source_diversity_index", 0.25), ("s", "source_diversity_index", 0.5), ("m", "unknown", 9.0), ("no_bound", "intercept", 0.5)], "metric string, feature string, coef double")
    bounds = spark.createDataFrame([("m", 0.1), ("s", 0.2), ("unused", 0.3)], "metric string, mae double")
    rows = serving.predict(requests, coefficients, bounds).select("request_id", "metric", "expected", F.round("lower", 4)).collect()
    # a metric whose only feature a request lacks has no sum
    assert {tuple(r)[:3] for r in rows if r["metric"] == "m"} == {(1, "m", 0.4375), (2, "m", 0.125), (3, "m", 0.125)}
    assert {(r["request_id"], r["expected"]) for r in rows if r["metric"] == "s" and r["request_id"] == 1} == {(1, 0.375)}
    assert {r["metric"] for r in rows} == {"m", "s"} and len(rows) == 6


def test_clean_text_and_counts_pass_by_what_is_not_there(spark):
    from quarry.functions import terms, text

    rows = spark.createDataFrame([("a  b\t c\u0085d \u00e9!",), ("<!-- x --><script>y</script>T&amp;lt;b",), ("1 < 2 & 3 > 0",), (" \n ",), (None,)], "t string")
    found = [tuple(r) for r in rows.select(text.clean_text(F.col("t")), text.normalize_text(F.col("t"))).collect()]
    assert found == [("a b c d \u00e9!", "a b c\u0085d \u00e9!"), ("T lt;b", "<!-- x --><script>y</script>t&amp;lt;b"), ("1 0", "1 < 2 & 3 > 0"), ("", ""), ("", "")]
    docs = spark.createDataFrame([("History museum", "live score of the archive; archive", "", "history"), ("", "captcha security check", "", "history")], "title string, text string, url string, domain string")
    a, b = terms.counted(docs).orderBy("t_past").collect()[::-1]
    # only asked words are looked through, and words are counted only where phrases ask for the number
    assert set(a["t_words"]) == {"history", "museum", "archive"} and (a["t_past"], a["t_offtopic"], a["t_n_words"]) == (3, True, None)
    assert (b["t_wall_text"], b["t_n_words"]) == (2, 3)


def test_metadata_is_filled_on_what_cleaning_keeps(spark):
    """The code of the classifiers is that of one stage, which has to stay small enough to compile."""
    from quarry.operators import quality
    from quarry.plans.corpora import KEYWORDS
    from quarry.schema import AS_OF, signals

    plan = executed(quality.clean_data(signals(spark, SF), AS_OF, KEYWORDS))
    below = plan[plan.index("CollectMetrics") :]
    assert "t_blob" in below and "freshness_window" not in below and "freshness_window" in plan


def test_response_metrics_hold_a_slice_of_a_batch(spark, monkeypatch):
    import pandas as pd

    from quarry.operators import evaluation

    seen = []
    monkeypatch.setattr(evaluation, "SLICE_CHARS", 10)
    score = evaluation.by_slices(lambda h, r: seen.append(len(h)) or h.fillna("").str.len().astype(float))
    found = score(pd.Series(["abcde", None, "x" * 30, "a", "b"]), pd.Series(["ab", "abc", None, "", None]))
    assert seen == [2, 1, 2] and found.tolist() == [5.0, 0.0, 30.0, 1.0, 1.0]
    assert score(pd.Series([], dtype=object), pd.Series([], dtype=object)).tolist() == []


def test_a_run_works_once_and_commits_by_batch(spark):
    from quarry.storage import new_path
    from quarry.streaming.runs import RunLog

    asked, schema = [], "query_id long, response string"

    def work(queries):
        asked.append(queries.count())
        return queries.where("query_id <> 7").select("query_id", F.concat(F.lit("r"), "query_id").alias("response"))

    class Dying(RunLog):
        def commit(self, number, batch):
            if number == 2:
                raise OSError("gone")
            return super().commit(number, batch)

    class Met(RunLog):
        met = False

        def write(self, records, batch):
            super().write(records, batch)
            if not self.met:  # another run commits while this one's first batch is written
                self.met = True
                RunLog(spark, self.path, schema).append(queries.where("query_id >= 30"), lambda q: q.select("query_id", F.lit("other").alias("response")))

    queries = spark.range(40).withColumnRenamed("id", "query_id")
    log = RunLog(spark, new_path(spark, "run"), schema)
    with pytest.raises(OSError):
        Dying(spark, log.path, schema).run(queries, work, batch_rows=10, once=True)
    some = log.records().count()
    assert asked == [40] and 0 < some < 39 and len(log.batches()) == 2
    assert log.run(queries, work, batch_rows=10, once=True) == 40 - some and asked == [40, 40 - some]
    assert sorted(r["query_id"] for r in log.records().collect()) == [i for i in range(40) if i != 7]
    # two runs at once: no query has two records
    met = Met(spark, new_path(spark, "run"), schema)
    met.run(queries, work, batch_rows=10, once=True)
    found = met.records().collect()
    assert sorted(r["query_id"] for r in found) == [i for i in range(40) if i != 7]
    assert {r["query_id"] for r in found if r["response"] == "other"} == set(range(30, 40))


def test_a_crawl_moves_no_text_with_its_links(spark):
    from quarry.operators import crawl

    pages = spark.createDataFrame([("https://a.org/1", "t", "x", '<a href="/2">n</a>'), ("https://a.org/2", "u", "y", "")], "url string, title string, text string, html string")
    found = crawl.seed_crawl(spark.createDataFrame([("https://a.org/1", 0)], "url string, place long"), pages)
    assert [(r["url"], r["title"], r["hop"]) for r in found.orderBy("hop").collect()] == [("https://a.org/1", "t", 0), ("https://a.org/2", "u", 1)]
    # texts are read once, for the pages that are taken
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "title#" in line.split("Relation")[1] for line in plan.splitlines()) >= 1
    assert "title#" not in plan[plan.index("Union") :].split("Relation")[0]
