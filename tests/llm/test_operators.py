"""The operators over small tables: brute force, nulls, empty and repeated rows, empty tables, clashing columns."""

import hashlib
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import bm25, bpe, exact_dedup, langid, line_dedup, maxent, mixing, near, simhash, substring_dedup, warc

LINE = "a line that is long enough to count"
LONG = " ".join(f"w{i}" for i in range(80))
TEXTS = ["", None, " \n ", LONG, LONG + " tail", "head " + LONG, f"{LINE}\nx", f"y\n{LINE.upper()}", f"  {LINE}", "Short one.", "Short one.", "ümlaut ñandú 中文 😀", "a " * 3000]
#: Extra columns bear the names that operators use inside.
EXTRA = ", id long, t string, fid long, n long, text2 string, gone string, copies long, digest string, keep_id long, fp long, root long"


def _docs(spark, rows, extra=True):
    schema = "doc_id long, text string, source string, lang string" + (EXTRA if extra else "")
    pad = (1, "t", 2, 3, "x", "g", 4, "d", 5, 6, 7) if extra else ()
    return spark.createDataFrame([(*r, *pad) for r in rows], schema)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, "en") for i, t in enumerate(TEXTS)]
    return _docs(spark, rows + [(3, LONG, "s0", "en"), (None, "no id at all", None, None)]).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return _docs(spark, [])


def test_line_dedup(docs, empty):
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert got[6]["text"] == "x" and got[7]["text"] == "y" and got[8]["text"] == f"  {LINE}"
    assert got[0]["n_lines"] == got[1]["n_lines"] == 1 and got[1]["text"] == "" and got[2]["n_lines"] == 2
    assert line_dedup.line_dedup(docs).count() == docs.count()
    assert line_dedup.line_dedup(empty).count() == 0


def test_exact_dedup(docs, empty, spark):
    rows = exact_dedup.exact_dedup(docs, files_per_batch=1).collect()
    assert len(rows) == docs.count()
    by_text = {r["digest"]: r for r in rows}
    same = by_text[hashlib.sha256(b"").hexdigest()]
    assert (same["keep_id"], same["group_size"]) == (1, 2)
    assert sum(r["kept"] for r in rows if r["doc_id"] == 3) == 1
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_checks_bytes(docs):
    weak = exact_dedup.exact_dedup(docs, digest=lambda t: F.substring(F.sha2(t, 256), 1, 1)).select("doc_id", "keep_id", "group_size", "kept")
    strong = exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept")
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, weak.collect()), key=key) == sorted(map(tuple, strong.collect()), key=key)


@pytest.mark.parametrize("digits", [64, 1])
def test_exact_dedup_goes_on(spark, digits):
    """Three ingests, each by a state opened anew, against plain groups of all rows so far; with one digit, most digests collide."""
    from quarry.llm._common import new_path

    path, seen = new_path(spark, "state"), []
    rng = random.Random(digits)
    weak = lambda t: F.substring(F.sha2(t, 256), 1, digits)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    for _ in range(3):
        rows = [(rng.randrange(1000), rng.choice([None, "", "a", "b" * 50, f"t{rng.randrange(12)}"])) for _ in range(30)]
        seen += rows
        got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=weak, state_path=path).collect()
        groups = {}
        for i, t in seen:
            groups.setdefault(t or "", []).append(i)
        want = sorted((i, max(groups[t or ""]), len(groups[t or ""])) for i, t in rows)
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
        assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string"), digest=weak, state_path=path).count() == 0
    state = exact_dedup.DedupState(spark, path, weak)
    kept = [r for k in (0, 2, 4) for r in state.decisions(k).where("kept").collect()]
    assert len(kept) == len(groups) and spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    sizes = {r["source"]: r["source_size"] for r in rows}
    targets = {r["source"]: r["target"] for r in rows}
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-6
    assert mixing.mix(empty).count() == 0


def test_mixing_reshares_what_caps_leave(spark):
    """Targets of several capped sources against a plain water-filling loop."""
    for sizes in ([1, 1, 1000], [5, 3, 2, 400, 1], [10, 10, 10], [0, 7, 0, 90]):
        rows = [(100 * k + i, "w", f"s{k}") for k, n in enumerate(sizes) for i in range(n)] + [(100000 + k, None, f"s{k}") for k in range(len(sizes))]
        weights, total = [(5, 2, 1)[k % 3] for k in range(len(sizes))], sum(sizes)
        want, free = [0.0] * len(sizes), set(range(len(sizes)))
        while free:
            share = (total - sum(want[k] for k in range(len(sizes)) if k not in free)) / sum(weights[k] for k in free)
            full = {k for k in free if share * weights[k] > 3 * sizes[k]}
            if not full:
                for k in free:
                    want[k] = share * weights[k]
                break
            for k in full:
                want[k] = 3.0 * sizes[k]
            free -= full
        got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
        assert [got[f"s{k}"][0] for k in range(len(sizes))] == sizes
        assert [got[f"s{k}"][1] for k in range(len(sizes))] == pytest.approx(want)


def test_langid(docs, empty):
    model = langid.fit({"en": ["the cat and the dog"], "de": ["der hund und die katze"]})
    rows = {r["doc_id"]: r for r in langid.identify(docs, model, keep=("lang", "id"), prefix="__").collect()}
    assert rows[0]["__lang_pred"] == rows[1]["__lang_pred"] == "und" and rows[0]["__score"] == 0
    assert langid.identify(empty, langid.train(empty)).count() == 0


def test_bpe(docs, empty):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    for r in bpe.bpe_encode(docs, path).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r["decoded"] == (r["text"] or "")
    assert bpe.bpe_digests(empty, path).count() == 0


def test_simhash(docs, empty, spark):
    rows = {r["doc_id"]: r for r in simhash.simhash_groups(docs).collect()}
    assert rows[0]["fingerprint"] == "0" * 16 and rows[0]["component_id"] == rows[1]["component_id"] == rows[2]["component_id"] == 0
    assert rows[9]["component_id"] == rows[10]["component_id"] == 9
    prints = {i: int(r["fingerprint"], 16) for i, r in rows.items()}
    label = {i: i for i in prints if i is not None}
    for _ in label:
        for i in label:
            for j in label:
                if bin(prints[i] ^ prints[j]).count("1") <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    assert all(rows[i]["component_id"] == c for i, c in label.items())
    assert simhash.simhash_groups(empty).count() == 0


def test_near_duplicates(spark):
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), " ".join(base[:390] + ["x"] * 10), " ".join(f"v{i}" for i in range(400)), "one two", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "__row long, text string")
    got = {r["__row"]: r["group"] for r in near.near_duplicate_groups(rows, "__row").collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    assert near.near_duplicate_groups(rows.where("false"), "__row").count() == 0


def test_substring_dedup(docs, empty, spark):
    for batches in (1, 3):
        rows = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs, window=50, batches=batches).collect()}
        assert rows[3]["n_removed"] == 0 and rows[4]["n_removed"] == 80 and rows[5]["n_removed"] == 80
        assert rows[4]["kept"] == b"tail" and rows[5]["kept"] == b"head"
        assert rows[12]["n_removed"] == 0 and rows[1]["n_words"] == 0
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_fingerprint_index_compacts(spark):
    from quarry.llm._common import new_path

    index = substring_dedup.FingerprintIndex(spark, new_path(spark, "t"), fan_in=2)
    batch = lambda rows: spark.createDataFrame(rows, "fp long, did long")
    assert {r[0] for r in index.ingest(batch([(1, 10), (2, 10), (2, 11)])).collect()} == {2}
    assert {r[0] for r in index.ingest(batch([(1, 12), (3, 12)])).collect()} == {1}
    assert len(index.runs) == 1 and index.history().count() == 5
    again = substring_dedup.FingerprintIndex(spark, index.path, fan_in=2)
    assert again.runs == index.runs
    assert {r[0] for r in again.ingest(batch([(3, 13)])).collect()} == {3}
    assert substring_dedup.FingerprintIndex(spark, index.path).history().count() == 6


def _cut_plainly(rows, judged, window):
    """{id: (n_words, n_removed, kept)} of the judged rows, by a dictionary of all windows of all rows."""
    words = {i: (t or "").split(" ") if t else [] for i, t in rows}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), i)
    out = {}
    for i in judged:
        w, gone = words[i], set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_substring_dedup_equals_brute_force(spark):
    from quarry.llm._common import new_path

    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    passages = [rng.choices(vocab, k=rng.randrange(12, 40)) for _ in range(8)]
    rows = [(0, None), (1, "")]
    for i in range(2, 90):
        parts = [rng.choices(vocab, k=rng.randrange(0, 60)) if rng.random() < 0.5 else rng.choice(passages) for _ in range(rng.randrange(1, 6))]
        rows.append((i, " ".join(w for p in parts for w in p)))
    rng.shuffle(rows)
    kind = "doc_id long, text string"
    got = lambda df: {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}
    want = _cut_plainly(rows, [i for i, _ in rows], 15)
    assert got(substring_dedup.substring_dedup(spark.createDataFrame(rows, kind), window=15, k=5, batches=3)) == want
    # the same rows by and by: each call judges its own only, against all before
    path, before = new_path(spark, "index"), []
    for part in (rows[:30], rows[30:60], rows[60:]):
        history = spark.createDataFrame(before, kind)
        now = substring_dedup.substring_dedup(spark.createDataFrame(part, kind), window=15, k=5, index_path=path, history=history)
        before = before + part
        assert got(now) == _cut_plainly(before, [i for i, _ in part], 15)


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a", "x", 1), (2, None, "x", 1), (3, "http://c", None, 1), (4, "http://d", "", 1), (None, "u", "é", 1)], "page_id long, url string, html string, h long")
    rows = {r["page_id"]: r for r in warc.warc_roundtrip(pages).collect()}
    assert (rows[1]["record_type"], rows[1]["refers_to"], rows[1]["payload_bytes"]) == ("revisit", 2, 1)
    assert rows[3]["refers_to"] == 4 and rows[4]["record_type"] == "response" and rows[4]["payload_digest"] == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert rows[None]["payload_bytes"] == 2
    assert warc.warc_roundtrip(pages.where("false")).count() == 0


def test_warc_reads_by_offset(spark):
    import json

    from quarry.llm._common import new_path

    folder = new_path(spark, "warc")
    rows = [(str(i), "u", f"page {i}".encode(), "response", warc.payload_digest(f"page {i}".encode()), None, len(f"page {i}")) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id string, uri string, payload binary, kind string, digest string, refers_to string, size long").coalesce(1)
    done = spark.createDataFrame(warc.write_archives(pages, folder).collect(), "archive string, records long")
    assert sorted(r["page_id"] for r in warc.read_archives(done, folder).collect()) == list("01234")
    name = done.first()["archive"]
    with warc.open_shared(f"{folder}/index/{name}.jsonl", "rb") as f:
        index = [json.loads(x) for x in f.read().splitlines()]
    whole = index[3]["offset"]
    for index[3]["offset"], good in ((index[2]["offset"] + 1, False), (whole, True)):
        lines = index[::-1]
        with warc.open_shared(f"{folder}/index/{name}.jsonl", "wb") as f:
            f.write(b"\n".join(json.dumps(x).encode() for x in lines))
        if good:
            assert sorted(r["page_id"] for r in warc.read_archives(done, folder).collect()) == list("01234")
        else:
            with pytest.raises(Exception):
                warc.read_archives(done, folder).collect()


def test_bm25(docs, empty):
    asked = docs.where("doc_id IN (3, 9)").select(F.col("doc_id").alias("query_id"), "text")
    rows = bm25.bm25_topk(docs, asked, k=3, shard_bytes=200).collect()
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == 9][:2] == [9, 10]
    assert bm25.bm25_topk(empty, asked).count() == 0 and bm25.bm25_topk(docs, asked.where("false")).count() == 0


def test_maxent(docs, empty):
    rows = maxent.lm_scores(docs, rounds=1).collect()
    assert len(rows) == docs.count()
    import zlib

    train, every = Counter(), []
    for r in docs.select("doc_id", "text").collect():
        words = (r["text"] or "").encode().lower().split() + [b""]
        every.append((r["doc_id"], words))
        if zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 != 2:
            train.update(words)
    n, v = sum(train.values()), len(train)
    want = {i: (len(w), sum(train[x] > 0 for x in w), sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)) for i, w in every}
    for r in rows:
        assert (r["n_tokens"], r["n_known"]) == want[r["doc_id"]][:2] and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][2]) and r["score"] < 0
    assert maxent.lm_scores(empty).count() == 0


def test_maxent_scores_equal_a_plain_version(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["red", "green", "blue"]) if k % 3 else f"n{rng.randrange(9)}" for k in range(rng.randrange(30)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    from quarry.llm._common import staged

    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    picked = docs.select(F.col("doc_id").alias("ord"), held.alias("held"), F.col("text").cast("binary").alias("text"))
    counts = staged(maxent.count_tokens(picked), "counts")
    vocab = maxent.build_vocabulary(counts)
    w = maxent.train(staged(maxent.encode(picked, vocab), "encoded"), vocab, 2)
    known = {bytes(r["token"]): r["n"] for r in counts.collect()}
    want = {}
    for i, text in rows:
        ids, total = [], 0.0
        for token in text.encode().split() + [b""]:
            at = vocab.index.get(token, -1)
            ids.append(int(vocab.ident[at]) if at >= 0 else maxent.FREQUENT + maxent.tail_class(token))
            context = np.array([(ids[-2] if len(ids) > 1 else maxent.START) << 16 | (ids[-3] if len(ids) > 2 else maxent.START)], np.uint64)
            klass = ids[-1] // maxent.WIDTH if ids[-1] < maxent.FREQUENT else ids[-1] - maxent.FREQUENT + maxent.HEAD
            logit = w.bias1.astype(float) + sum(w.table1[r[0]] for r in maxent.rows_of(context))
            total += logit[klass] - math.log(sum(math.exp(x) for x in logit))
            if ids[-1] < maxent.FREQUENT:
                logit = w.bias2[klass].astype(float) + sum(w.table2[r[0]] for r in maxent.rows_of(context, np.array([klass])))
                total += logit[ids[-1] % maxent.WIDTH] - math.log(sum(math.exp(x) for x in logit))
            else:
                total += math.log(known.get(token, 0) + 1) - math.log(10) * vocab.tail_norm[klass - maxent.HEAD]
        want[i] = total / math.log(10)
    got = {r["doc_id"]: r for r in maxent.lm_scores(docs).collect()}
    assert all(got[i]["score"] == pytest.approx(want[i], rel=1e-4, abs=1e-4) for i in want)
    # words follow a pattern that counts alone don't know
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_models_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = [r for r in maxent.lm_scores(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in scored) > 0.99 * sum(r["base_score"] for r in scored) + 0.3 * sum(r["n_tokens"] for r in scored) / math.log2(10)
    found = langid.identify(docs, langid.train(docs), keep=("lang",)).where(~langid.training_rows(docs, "doc_id") & F.col("lang").isNotNull() & (F.col("lang_pred") != "und")).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.98 * len(found) > 100
    assert all(0 <= r["score"] <= 1 for r in found) and sum(r["rejected"] for r in found) <= 0.01 * len(found)


def test_bpe_digests_equal_the_library(docs):
    import hashlib

    from public_tokenizers import path
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in bpe.bpe_digests(docs, path("byte_bpe_50k.json")).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("step,name", [("_stream", None), ("_check", "monday"), ("done", None)])
def test_exact_dedup_counts_once_after_a_failure(spark, monkeypatch, step, name):
    """An ingest that fails after its arrivals, after the stream or before it is marked done, made again: nothing is counted twice and its hits are checked."""
    from quarry.llm._common import new_path

    weak = lambda t: F.substring(F.sha2(t, 256), 1, 1)
    path = new_path(spark, "state")
    rows = [(i, f"t{i % 3}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    earlier = spark.createDataFrame([(100, "t0"), (101, "other")], "doc_id long, text string")
    exact_dedup.exact_dedup(earlier, digest=weak, state_path=path)
    target = "_finish" if step == "done" else step
    real = getattr(exact_dedup.DedupState, target)

    def failing(self, *a):
        if step == "done":
            with monkeypatch.context() as inner:
                inner.setattr(type(spark), "createDataFrame", lambda *b, **k: (_ for _ in ()).throw(RuntimeError("killed")))
                real(self, *a)
        elif step == "_stream":
            raise RuntimeError("killed")
        else:
            real(self, *a)
            raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(exact_dedup.DedupState, target, failing)
        with pytest.raises(RuntimeError):
            exact_dedup.exact_dedup(docs, digest=weak, state_path=path, name=name)
    key = lambda df: sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect())
    want = [(0, 100, 3, False), (1, 4, 2, False), (2, 5, 2, False), (3, 100, 3, False), (4, 4, 2, True), (5, 5, 2, True)]
    assert key(exact_dedup.exact_dedup(docs.repartition(2), digest=weak, state_path=path, name=name)) == want
    # a named ingest that is done is not taken in again; without a name the same rows are new arrivals
    again = key(exact_dedup.exact_dedup(docs, digest=weak, state_path=path, name=name))
    assert again == want if name else [r[2] for r in again] == [5, 4, 4, 5, 4, 4]
    # other rows after a failure: the open ingest is finished first
    with monkeypatch.context() as m:
        m.setattr(exact_dedup.DedupState, "_stream", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            exact_dedup.exact_dedup(spark.createDataFrame([(200, "new"), (201, "t1")], "doc_id long, text string"), digest=weak, state_path=path)
    last = key(exact_dedup.exact_dedup(spark.createDataFrame([(300, "new")], "doc_id long, text string"), digest=weak, state_path=path))
    assert last == [(300, 300, 2, True)]
    state = exact_dedup.DedupState(spark, path, weak)
    assert not state._epochs() and len(os.listdir(f"{path.removeprefix('file://')}/groups")) == 2


def test_langid_sample_is_bounded_before_it_is_collected(spark, monkeypatch):
    """Very long documents, rows without ids and many copies of one row: the sample has its code points and no more, and every language has one."""
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda samples: seen.update(samples))
    rows = [(i, f"long{i} " * 5000, "en") for i in range(60)] + [(None, f"kein name {i}", "de") for i in range(500)] + [(7, "copie", "fr")] * 300 + [(1, None, "es"), (2, "sin", None)]
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), sample_docs=30, sample_chars=100_000)
    assert sum(map(len, seen["en"])) == 100_000 and 5 < len(seen["de"]) < 100 and len(set(seen["de"])) == len(seen["de"]) and set(seen) <= {"en", "de", "fr"}
    assert len(seen.get("fr", [])) <= 1
