"""The pipeline's stages against plain versions of what they must do, on the smallest tables."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_stages(spark):
    import corpus_pipeline as p
    from quarry.llm._common import staged

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # rows that repeat, a copy under another id, a null text, a column with a helper's name
    more = docs.limit(3).union(docs.limit(3)).union(docs.limit(1).withColumn("doc_id", F.lit(10**6).cast("long"))).union(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(10**6 + 1).cast("long")))
    docs = docs.union(more).withColumn("copies", F.lit(7)).withColumn("row", F.col("doc_id") % 3).withColumn("__row", F.col("doc_id") + 1).withColumn("rejected", F.lit("no"))
    columns = docs.columns
    kept = {}
    for name, stage in p.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), name)
        assert docs.columns == columns
        kept[name] = docs.toPandas()
    assert all((k["row"] == k.doc_id % 3).all() and (k["__row"] == k.doc_id + 1).all() and (k["copies"] == 7).all() for k in kept.values())
    first = kept["language_id"]
    assert first.text.notna().all() and first.text.str.contains(r"[^\W\d_]").all()
    exact = kept["exact_dedup"]
    assert exact.text.is_unique and set(exact.text) == set(first.text)
    want = first.groupby("text").doc_id.max().to_dict()
    assert dict(zip(exact.text, exact.doc_id)) == want

    near = kept["simhash_near_dedup"]
    sets = {}
    for i, t in zip(exact.doc_id, exact.text):
        w = t.encode().lower().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or {b" ".join(w)}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    left = sorted(near.doc_id)
    assert not [(a, b) for a in left for b in left if a < b and alike(a, b) >= 0.8]
    gone = set(exact.doc_id) - set(left)
    assert all(any(alike(g, x) >= 0.8 for x in sets if x != g) for g in gone)

    mixed = kept["mix_sources"]
    assert set(mixed.doc_id) <= set(left) and mixed.groupby("doc_id").size().max() <= 3
    again = staged(p.mix_sources(spark, spark.createDataFrame(near), SF), "again").toPandas()
    assert sorted(again.doc_id) == sorted(mixed.doc_id)

    last = p.STAGES[-1][1](spark, docs, SF).toPandas()
    assert len(last) == len(mixed)
    digest = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in zip(near.doc_id, near.text)}
    assert all(digest[i] == d for i, d in zip(last.doc_id, last.decoded_sha256))


def test_stages_take_odd_tables(spark):
    import corpus_pipeline as p

    kind = "doc_id {}, text string, lang string, source string, n_chars long, doc string"
    empty = spark.createDataFrame([], kind.format("long"))
    for _, stage in p.STAGES:
        assert stage(spark, empty, SF).collect() == []
    # ids that are texts, some null, some repeated; null texts and sources
    rows = [("b", "one two three four five six", "en", None, 1, "x"), ("b", "one two three four five six", "en", None, 1, "x"), (None, None, None, "s", None, None), ("a", "", None, "s", 0, "y"), (None, "one two three four five six", "en", "s", 1, "z")]
    docs = spark.createDataFrame(rows, kind.format("string"))
    assert sorted(str(r.doc_id) + str(r.doc) for r in p.exact(spark, docs, SF).collect()) == ["ay", "bx"]
    assert sorted(str(r.doc_id) + str(r.doc) for r in p.near(spark, docs, SF).collect()) == ["ay", "bx"]
    mixed = [tuple(r) for r in p.mix_sources(spark, docs, SF).collect()]
    assert set(mixed) <= set(rows) and mixed.count(rows[0]) <= 6


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_stages_leave_little_on_disk(spark, tmp_path, monkeypatch):
    import corpus_pipeline as p
    from quarry.llm import _common

    monkeypatch.setattr(_common, "shared_dir", lambda spark: f"file://{tmp_path}")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage in (p.exact, p.near):
        held = _bytes(tmp_path)
        done = stage(spark, docs, SF)
        assert _bytes(tmp_path) - held < 60_000  # the rows that go, and no text, shingle or state
        docs = _common.staged(done, "done")
    assert sorted(x.name.rpartition("-")[0] for x in tmp_path.iterdir()) == ["done", "done", "exact-gone", "near-gone"]
    held = set(tmp_path.iterdir())
    assert p.run(spark, SF).count() > 0
    # of the stages' tables, only the one that the last stage reads is left
    assert [x.name.rpartition("-")[0] for x in tmp_path.iterdir() if x not in held] == ["mix_sources"]


@pytest.mark.parametrize("bits", [1, 64, 1 << 23])
def test_rows_go_whatever_the_filter_lets_through(spark, monkeypatch, bits):
    import corpus_pipeline as p

    monkeypatch.setattr(p, "DROP_BITS", bits)
    rows = spark.range(500).select(F.col("id").alias("row"), F.struct(F.col("id").alias("doc_id"), F.lit("t").alias("text")).alias("doc"))
    for gone in ([], [3], list(range(0, 500, 7)), list(range(500))):
        got = p._without(rows, spark.createDataFrame([(x,) for x in gone], "row long"))
        assert got.columns == ["doc_id", "text"]
        assert sorted(r.doc_id for r in got.collect()) == sorted(set(range(500)) - set(gone))
