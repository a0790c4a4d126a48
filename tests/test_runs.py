"""Condition indexes, run logs, crawls, artifacts and publishing: what is kept, what a failure leaves, and who reads what."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import crawl, indexes
from quarry.operators.retrieval import top_k
from quarry.sources import artifacts
from quarry.storage import child_names, commit_file, new_path
from quarry.streaming import runs


def _docs(spark, rows):
    return spark.createDataFrame(rows, "condition_id string, doc_id long, embedding array<double>")


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path.removeprefix("file://")) for f in fs}


def test_condition_indexes_are_built_once(spark):
    rng = random.Random(1)
    rows = [(f"C{i % 3}", i, [rng.random() for _ in range(4)]) for i in range(60)] + [("a/b =c", 99, [1.0, 0.0, 0.0, 0.0]), (None, 100, [1.0] * 4)]
    path = new_path(spark, "indexes")
    told = lambda r: {x["condition_id"]: x["status"] for x in r.collect()}
    assert set(told(indexes.build_indexes(_docs(spark, rows), path)).values()) == {"built"}
    before = _files(path)
    # the same rows in another order: nothing is written
    assert set(told(indexes.build_indexes(_docs(spark, rows[::-1]), path)).values()) == {"kept"} and _files(path) == before
    # one condition changes, one breaks, one is gone, one is new
    changed = [(c, i, [9.0, 0.0, 0.0, 1.0] if i == 3 else v) for c, i, v in rows if c != "C2"] + [("C1", 500, [1.0, float("nan"), 0.0, 0.0]), ("C9", 700, [0.0, 1.0, 0.0, 0.0])]
    report = {r["condition_id"]: r for r in indexes.build_indexes(_docs(spark, changed), path).collect()}
    assert {c: r["status"] for c, r in report.items()} == {"C0": "built", "C1": "failed", "C2": "gone", "C9": "built", "a/b =c": "kept"}
    assert report["C1"]["error"] == "1 rows without an id or a whole vector" and report["C0"]["dim"] == 4
    held = {r["doc_id"]: (r["condition_id"], r["unit"]) for r in indexes.read_indexes(spark, path).collect()}
    assert {i for i, (c, _) in held.items() if c == "C1"} == set(range(1, 60, 3)) and held[99][0] == "a/b =c" and 2 not in held
    assert held[3][1] == pytest.approx([9 / 82**0.5, 0, 0, 1 / 82**0.5])
    assert told(indexes.build_indexes(_docs(spark, changed), path, force=True))["C0"] == "built"
    assert indexes.build_indexes(_docs(spark, []), new_path(spark, "indexes")).count() == 0
    uneven = indexes.build_indexes(_docs(spark, [("X", 1, [1.0]), ("X", 2, [1.0, 2.0])]), new_path(spark, "indexes")).first()
    assert (uneven["status"], uneven["error"]) == ("failed", "vectors of different lengths")


def test_index_build_that_dies_leaves_the_former_one(spark, monkeypatch):
    path = new_path(spark, "indexes")
    indexes.build_indexes(_docs(spark, [("C1", 1, [1.0, 0.0])]), path)

    def dies(*a):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(indexes, "commit_file", dies)
        with pytest.raises(RuntimeError):
            indexes.build_indexes(_docs(spark, [("C1", 2, [0.0, 1.0])]), path)
    assert [r["doc_id"] for r in indexes.read_indexes(spark, path).collect()] == [1]
    assert [r["status"] for r in indexes.build_indexes(_docs(spark, [("C1", 2, [0.0, 1.0])]), path).collect()] == ["built"]
    assert [r["doc_id"] for r in indexes.read_indexes(spark, path).collect()] == [2]


def test_top_k_by_condition_reads_its_own_folders(spark):
    rng = random.Random(2)
    rows = [(f"C{i % 4}", i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(200)]
    path = new_path(spark, "indexes")
    indexes.build_indexes(_docs(spark, rows), path)
    asked = spark.createDataFrame([(q, f"C{q % 5}", [rng.gauss(0, 1) for _ in range(3)]) for q in range(12)], "query_id long, condition_id string, q array<double>")
    got = indexes.top_k_by_condition(spark, path, asked, 4).collect()
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    want = []
    for r in asked.collect():
        scored = sorted((-round(sum(a * b for a, b in zip(unit(v), unit(r["q"]))), 6), i) for c, i, v in rows if c == r["condition_id"])
        want += [(r["condition_id"], r["query_id"], k + 1, i, -s) for k, (s, i) in enumerate(scored[:4])]
    assert [x[:4] for x in sorted(map(tuple, got))] == [x[:4] for x in sorted(want)]
    only = indexes.read_indexes(spark, path, ["C2"])
    assert all("condition_id=C2" in f for f in only.inputFiles()) and only.count() == 50
    assert indexes.top_k_by_condition(spark, path, asked.where("false"), 4).count() == 0


def test_top_k_in_slices(spark, monkeypatch):
    from quarry.operators import retrieval

    rng = random.Random(3)
    e = spark.createDataFrame([(i, [rng.choice([0.0, 1.0]) for _ in range(3)]) for i in range(300)], "id long, v array<double>")
    asked = e.where("id < 20").select(F.col("id").alias("q"), F.col("v").alias("w"))
    whole = sorted(map(tuple, top_k(e, asked, 7, "id", "v", "q", "w").collect()))
    monkeypatch.setattr(retrieval, "SCORES", 1)
    monkeypatch.setattr(retrieval, "SHARD_ROWS", 11)
    assert sorted(map(tuple, top_k(e, asked, 7, "id", "v", "q", "w").collect())) == whole and len(whole) == 140


def _work(queries):
    return queries.select("query_id", F.concat(F.lit("r"), F.col("query_id").cast("string")).alias("response"))


def test_run_log_goes_on_after_a_kill(spark):
    log = runs.RunLog(spark, new_path(spark, "run"), "query_id long, response string")
    queries = spark.createDataFrame([(i,) for i in range(40)] + [(None,)], "query_id long")
    first, done = queries.where("query_id < 10"), lambda: sorted(r["query_id"] for r in log.records().collect())
    assert log.append(first, _work) and done() == list(range(10))
    # killed between write and commit: the batch counts for nothing and its queries are pending
    log.write(_work(queries.where("query_id BETWEEN 10 AND 19")), "lost")
    assert done() == list(range(10))
    assert runs.pending(queries.where("query_id IS NOT NULL"), log.records(), "query_id").count() == 30

    class Killed(Exception):
        pass

    seen = []

    class Dying(runs.RunLog):
        def commit(self, number, batch):
            seen.append(batch)
            if len(seen) == 2:
                raise Killed
            return super().commit(number, batch)

    with pytest.raises(Killed):
        Dying(spark, log.path, log.schema).run(queries, _work, batch_rows=10)
    some = done()
    assert 10 < len(some) < 40 and len(set(some)) == len(some)
    assert log.run(queries, _work, batch_rows=10) == 40 - len(some)
    assert done() == list(range(40)) and log.run(queries, _work) == 0
    assert set(log.vacuum()) == {"lost", seen[1]} and done() == list(range(40))


def test_run_log_commits_once(spark):
    """Two runs with one batch each: the second finds the first's commit and makes its batch again without those queries."""
    log = runs.RunLog(spark, new_path(spark, "run"), "query_id long, response string")
    queries, calls = spark.createDataFrame([(i,) for i in range(6)], "query_id long"), []

    def interrupted(pending):
        calls.append(sorted(r["query_id"] for r in pending.collect()))
        if len(calls) == 1:
            assert runs.RunLog(spark, log.path, log.schema).append(queries.where("query_id < 3"), _work)
        return _work(pending)

    assert log.run(queries, interrupted) == 6
    assert calls == [[0, 1, 2, 3, 4, 5], [3, 4, 5]]
    assert sorted(r["query_id"] for r in log.records().collect()) == list(range(6))
    # a query that work leaves out stays pending
    some = runs.RunLog(spark, new_path(spark, "run"), "query_id long, response string")
    some.run(queries, lambda q: _work(q.where("query_id <> 4")))
    assert [r["query_id"] for r in runs.pending(queries, some.records(), "query_id").collect()] == [4]


def test_commit_file_never_replaces(spark):
    path = new_path(spark, "commits")
    commit_file(spark, f"{path}/000", [1])
    with pytest.raises(Exception):
        commit_file(spark, f"{path}/000", [2])
    assert child_names(spark, path) == ["000"] and child_names(spark, f"{path}/none") == []


def test_host_verdicts(spark):
    hosts = spark.createDataFrame([(h,) for h in ("a.b.org", "b.org", "xb.org", "www.B.org", "c.net", "", None, "c.net", "d.c.net")], "host string")
    table = lambda *h: spark.createDataFrame([(x,) for x in h], "host string")
    got = lambda **k: sorted(r["host"] for r in crawl.host_verdicts(hosts, **k).collect())
    assert got() == ["a.b.org", "b.org", "c.net", "d.c.net", "xb.org"]
    assert got(deny=table("B.org")) == ["c.net", "d.c.net", "xb.org"]
    assert got(allow=table("www.b.org", "net")) == ["a.b.org", "b.org", "c.net", "d.c.net"]
    assert got(deny=table("d.c.net"), allow=table("net")) == ["c.net"]


def test_result_links(spark):
    html = '<a href="/url?q=https://x.org/1">1</a><a href="https://X.org/1">again</a><a href="https://bad.net/2">2</a><a href="mailto:x">m</a><a href="/own">o</a><a href="https://x.org/3#top">3</a>'
    pages = spark.createDataFrame([(1, html, "https://search.com/q"), (2, None, "https://search.com/q"), (3, "<p>none</p>", None)], "id int, html string, base string")
    deny = spark.createDataFrame([("bad.net",), ("search.com",)], "host string")
    rows = lambda **k: [(r["id"], r["place"], r["link"]) for r in crawl.result_links(pages, "id", "html", "base", 2, deny, **k).orderBy("id", "place").collect()]
    assert rows() == [(1, 1, "https://x.org/1"), (1, 2, "https://x.org/3")]
    # cut first: the second of the first two is denied
    assert rows(limit_first=True) == [(1, 1, "https://x.org/1")]


def test_seed_crawl(spark):
    page = lambda *links: "".join(f'<a href="{x}">x</a>' for x in links)
    pages = [
        ("https://a.org/1", "A", "hub", page("/2", "/3", "/4", "https://b.org/5")), ("https://a.org/2", "Two", "text", ""), ("https://a.org/3", "404", "Not Found here", ""), ("https://b.org/5", "Five", "", ""),
        ("https://c.org/2", "ok", "fine", page("https://A.org/2")), ("https://c.org/3", "", " ", ""), ("https://c.org/4", "late", "never fetched", ""), ("https://d.org/x", "Page not found", "", page("https://a.org/1")),
    ]
    pages = spark.createDataFrame(pages, "url string, title string, text string, html string")
    seeds = spark.createDataFrame([("https://a.org/1", 0), ("https://c.org/2", 1), ("https://c.org/3", 2), ("https://c.org/4", 3), ("https://gone.org/", 4), ("https://d.org/x", 5), ("https://A.org/1", 6), ("", 7)], "url string, place int")
    got = lambda **k: [(r["url"], r["place"], r["hop"]) for r in crawl.seed_crawl(seeds, pages, **k).orderBy("place", "hop").collect()]
    taken = [("https://a.org/1", 0, 0), ("https://a.org/2", 0, 1), ("https://b.org/5", 0, 4), ("https://c.org/2", 1, 0)]
    assert got() == taken
    assert got(threshold=2) == taken + [("https://c.org/4", 3, 0)]
    assert got(limit=2) == taken[:2] and got(children=1) == [taken[0], taken[1], taken[3]]
    # an error page's links are followed all the same; what is excluded is not taken, but its links are
    assert got(excluded=spark.createDataFrame([("HTTPS://a.org/1",)], "url string")) == taken[1:]
    assert got(candidate=lambda u: ~u.contains("b.org"), wanted=lambda u, t, x: t != "Two") == [taken[0], taken[3]]
    assert crawl.seed_crawl(seeds.where("false"), pages).count() == 0


def test_seeds_and_scans(spark):
    seeds = spark.createDataFrame([("k", "B", 0), ("k", "b", 1), ("k", "c", 2), ("k", "a", 3), ("l", "b", 0)], "list string, seed string, p int")
    assert [(r["list"], r["seed"]) for r in crawl.rotated_seeds(seeds, "list", "seed", "p", 1).orderBy("list", "place").collect()] == [("k", "c"), ("k", "a"), ("k", "B"), ("l", "b")]
    one = spark.createDataFrame([("x", 2), ("", 1), ("y", 3)], "url string, p int")
    two = spark.createDataFrame([("y", 0), ("z", 1), ("", 5)], "url string, p int")
    assert [(r["url"], r["p"]) for r in crawl.ordered_union([one, two], F.col("url"), "p", 4).collect()] == [("", 1), ("x", 2), ("y", 3), ("z", 1)]


def test_artifacts_are_read_once_and_anew_when_changed(spark):
    path = new_path(spark, "artifact") + ".json"
    held = artifacts.Artifacts(spark)
    with pytest.raises(FileNotFoundError):
        held.get(path)
    spark.createDataFrame([(1, "a")], "n long, t string").write.json(path)
    assert held.get(path).collect() == held.get(path).collect() and held.reads == 1
    spark.createDataFrame([(1, "a"), (2, "b")], "n long, t string").write.mode("overwrite").json(path)
    assert held.get(path).count() == 2 and held.reads == 2
    held.clear()
    assert held.get(path).count() == 2 and held.reads == 3
    held.clear()


def test_publish_switches_once(spark, monkeypatch):
    source, target = new_path(spark, "source"), new_path(spark, "target")
    for name, n in (("a", 3), ("b", 5)):
        spark.range(n).write.parquet(f"{source}/{name}")
    report = {r["name"]: r["status"] for r in artifacts.publish(spark, {"a": f"{source}/a", "b": f"{source}/b", "c": f"{source}/c"}, target).collect()}
    assert report == {"a": "copied", "b": "copied", "c": "missing"}
    old = artifacts.published(spark, target)
    assert set(old) == {"a", "b"} and spark.read.parquet(old["b"]).count() == 5
    spark.range(4).write.mode("overwrite").parquet(f"{source}/a")
    # the second copy fails: the old set is in force and readable
    real, calls = artifacts.read_table, []

    def failing(spark_, path):
        calls.append(path)
        if len(calls) == 2:
            raise OSError("disk")
        return real(spark_, path)

    with monkeypatch.context() as m:
        m.setattr(artifacts, "read_table", failing)
        with pytest.raises(OSError):
            artifacts.publish(spark, {"a": f"{source}/a", "b": f"{source}/b"}, target)
    assert artifacts.published(spark, target) == old and spark.read.parquet(old["a"]).count() == 3
    kept = {r["name"]: r["status"] for r in artifacts.publish(spark, {"a": f"{source}/a", "c": f"{source}/c"}, target, partial=False).collect()}
    assert kept == {"a": "kept back", "c": "missing"} and artifacts.published(spark, target) == old
    artifacts.publish(spark, {"a": f"{source}/a"}, target)
    new = artifacts.published(spark, target)
    assert spark.read.parquet(new["a"]).count() == 4 and new["b"] == old["b"] and spark.read.parquet(old["a"]).count() == 3


def test_stages_go_on_after_a_failure(spark):
    from quarry.streaming.stages import run_stages, stage_table

    base, calls = new_path(spark, "stages"), []

    def stage(name, n, fails=False):
        def work(tables):
            calls.append(name)
            if fails:
                raise ValueError("no luck")
            return spark.range(n + sum(t.count() for t in tables.values()))

        return name, work

    told = lambda df: [(r["stage"], r["status"], r["rows"]) for r in df.collect()]
    report = run_stages(spark, [stage("a", 2), stage("b", 3, fails=True), stage("c", 1)], base)
    assert told(report) == [("a", "made", 2), ("b", "failed", None), ("c", "skipped", None)] and report.collect()[1]["error"] == "no luck"
    with pytest.raises(FileNotFoundError):
        stage_table(spark, base, "b")
    good = [stage("a", 2), stage("b", 3), stage("c", 1)]
    assert told(run_stages(spark, good, base)) == [("a", "kept", 2), ("b", "made", 5), ("c", "made", 8)]
    assert told(run_stages(spark, good, base)) == [("a", "kept", 2), ("b", "kept", 5), ("c", "kept", 8)] and calls == ["a", "b", "b", "c"]
    # a stage is asked for that hangs on one that is not there; one is made anew, and what hangs on it
    assert told(run_stages(spark, good, new_path(spark, "stages"), only=["b"])) == [("a", "missing", None), ("b", "skipped", None), ("c", "skipped", None)]
    assert told(run_stages(spark, [good[0], stage("b", 10), good[2]], base, only=["b", "c"], force=True)) == [("a", "kept", 2), ("b", "made", 12), ("c", "made", 15)]
