"""Near-duplicate groups against brute force over exact Jaccard similarities, on both sides of the bound."""

import random
from itertools import combinations

import numpy as np
import pytest

from quarry.llm import near
from quarry.llm import simhash


def _sets(rows, width=5):
    return {i: set(simhash.shingles((t or "").encode(), width)) or {b""} for i, t in rows}


def _groups(rows, similarity=0.8):
    """Least id of each component, and every pair's similarity."""
    sets, root = _sets(rows), {i: i for i, _ in rows}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(sets), 2)}
    for (a, b), x in alike.items():
        if x >= similarity - 1e-12 and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    return root, alike


def _edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"e{rng.random()}"
    return out


@pytest.mark.parametrize("long", [64, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, long):
    monkeypatch.setattr(near, "LONG", long)
    monkeypatch.setattr(near, "TILE_BYTES", 1 << 14)
    rng = random.Random(11)
    texts = [None, "", "one", "ONE ", "a b c d e", "a b c d e f"]
    for k in range(120):
        n = rng.choice([60, 150, 400])
        words = [f"w{rng.random()}" for _ in range(n)]
        # each edit takes five shingles of n - 4, so these lie on both sides of 0.8
        texts += [" ".join(words), " ".join(_edited(rng, words, max(1, round(n * rng.choice([0.018, 0.022, 0.025]))))), " ".join(words + words[: n // 4])]
    base = [f"b{k}" for k in range(200)]
    texts += [" ".join(_edited(rng, base, rng.randrange(7))) for _ in range(90)]
    rows = list(enumerate(texts))
    want, alike = _groups(rows)
    assert sum(0.8 <= x < 0.83 for x in alike.values()) > 20 and sum(0.77 <= x < 0.8 for x in alike.values()) > 20
    docs = spark.createDataFrame([(i, t) for i, t in rows], "__row long, text string")
    got = {r["__row"]: r["group"] for r in near.near_duplicate_groups(docs, "__row").collect()}
    assert got == want


def test_prefix_and_tiles():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 200, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 200, int(rng.integers(0, 4))).astype(np.uint64))))
        if not len(b):
            continue
        common = np.sort(rng.choice(200, 40, replace=False)).astype(np.uint64)
        count = rng.integers(2, 9, 40)
        alike = len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8 - 1e-12
        assert near.similar(a, b, 0.8) == alike
        assert (len(near.set_links([a], [b], 0.8)[0]) == 1) == alike
        if alike:
            assert len(np.intersect1d(near.prefix(a, common, count, 0.8), near.prefix(b, common, count, 0.8)))


def _counts(monkeypatch):
    """Rows of the tables that near.py stages, by name."""
    counts, staged = {}, near.staged

    def counted(df, name, *more):
        out = staged(df, name, *more)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near, "staged", counted)
    return counts


def test_sets_moved_for_a_group_grow_with_its_rows(spark, monkeypatch):
    """A group of near copies is joined by a pair a row, not by all its pairs."""
    counts, rng = _counts(monkeypatch), random.Random(5)
    base = [f"b{k}" for k in range(300)]
    rows = [(i, " ".join(_edited(rng, base, 2))) for i in range(60)]
    got = {r["id"]: r["group"] for r in near.near_duplicate_groups(spark.createDataFrame(rows, "id long, text string"), "id").collect()}
    assert got == _groups(rows)[0] and set(got.values()) == {0}
    assert counts["bounded-pairs"] < 3 * len(rows)


def test_one_shared_shingle_makes_no_pair(spark, monkeypatch):
    """Texts that have one shingle in common are no candidates; texts of one shingle still meet."""
    counts, rng = _counts(monkeypatch), random.Random(6)
    word = lambda: f"w{rng.random()}"
    rows = [(100 * g + i, " ".join([*(word() for _ in range(20)), f"s{g} a b c d", *(word() for _ in range(20))])) for g in range(12) for i in range(20)]
    rows += [(5000, "one two three four five"), (5001, "One two three four FIVE"), (5002, "one two"), (5003, "one  two")]
    got = {r["id"]: r["group"] for r in near.near_duplicate_groups(spark.createDataFrame(rows, "id long, text string"), "id").collect()}
    assert got == {i: {5001: 5000, 5003: 5002}.get(i, i) for i, _ in rows}
    assert counts["candidates"] == 0
