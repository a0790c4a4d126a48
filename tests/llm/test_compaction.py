"""The query's own batches reach compaction, and merged runs are gone from the shared folder."""

import os

from quarry.llm import substring_dedup


def test_production_batches_are_compacted(spark, monkeypatch):
    seen = []
    compact = substring_dedup.FingerprintIndex.compact

    def watched(self):
        old = list(self.runs)
        before = sorted(r["fp"] for r in self.history().collect())
        compact(self)
        assert len(self.runs) == 1 and sorted(r["fp"] for r in self.history().collect()) == before
        assert not any(os.path.exists(p.removeprefix("file://")) for p in old)
        seen.append(len(old))

    monkeypatch.setattr(substring_dedup.FingerprintIndex, "compact", watched)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i : i + 90])) for i in range(0, 300, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(docs).collect()}
    assert seen == [2]
    assert got == {i: 80 if i else 0 for i, _ in rows}
