"""Threshold search, hard negatives and token files against brute force, with odd tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import negatives, threshold, token_files

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: Extra columns bear the names that operators use inside.
EXTRA = ", id long, query long, t string, tie long, score long, row long"
PAD = (1, 2, "t", 3, 4, 5)


def _terms(text):
    return TERM.findall((text or "").translate(UPPER))


def _ranked(docs, items, k):
    """Rows (item, rank, doc, score) by scoring every document."""
    bags = [(i, Counter(_terms(t))) for i, t in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(_terms(t))
    out = []
    for item, words in asked.items():
        scored = []
        for i, b in bags:
            if i is None or not b:
                continue
            m = 50 + (50 * b.total() * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m)) for t in words if t in b)
            if s > 0:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_terms_equal_the_pattern():
    text = "Ünïcode WORDS x9 \x00a\x7fb 中文,字 \u0085 É_E-mail\x1c[Z]"
    assert [t.decode() for t in threshold.terms(text.encode())] == _terms(text)
    assert threshold.terms(None) == threshold.terms(b"") == []


def test_threshold_topk_equals_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randrange(1, 60)))) for i in range(400)]
    # ties: one text many times, under rising and falling ids; nulls, blanks, a long text, repeated rows, a row without an id
    docs += [(1000 + i, "Same TEXT w1 w2 w3") for i in range(150)] + [(500, None), (501, ""), (502, " ., "), (503, "w1 " * 200_000), (7, docs[7][1]), (None, "w1 w2 lonely")]
    items = [(i, " ".join(rng.choices(vocab, k=25))) for i in range(12)] + [(20, "same text"), (21, None), (22, "nowhere"), (23, "lonely w2"), (20, "w3"), (None, "w1")]
    frame = spark.createDataFrame([(*r, *PAD) for r in docs], "doc_id long, text string" + EXTRA).repartition(5)
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    for k, size in ((50, 1 << 25), (3, 400), (1000, 4000)):
        got = sorted(map(tuple, threshold.threshold_topk(frame, asked, k=k, shard_bytes=size).collect()))
        assert got == _ranked(docs, items, k)
    assert threshold.threshold_topk(frame.where("false"), asked).count() == 0
    assert threshold.threshold_topk(frame, asked.where("false")).count() == 0


def test_threshold_search_stops_early():
    """Accesses of a shard: fewer than all postings of the lists, and only documents met are looked up."""
    rng = random.Random(3)
    texts = [" ".join(f"w{int(rng.paretovariate(1.0)) % 200}" for _ in range(rng.randrange(20, 200))).encode() for _ in range(5000)] + [b"rare best words w1 w2"] * 20
    length = sum(len(threshold.terms(t)) for t in texts)
    shard = threshold.ForwardShard(list(range(len(texts))), texts, len(texts), length)
    ids, scores, done = shard.search([b"rare", b"best", b"w1", b"w2"], [6000, 6000, 1500, 2000], 10)
    assert ids.tolist() == list(range(5000, 5010)) and len(set(scores.tolist())) == 1
    assert done["sorted"] < done["postings"] / 4 and done["random"] <= done["sorted"]
    assert not shard.seen.any() and not shard.weight.any()
    # equal scores at the threshold go on: the smallest ids win although their postings come last
    every = threshold.ForwardShard(list(range(400, 0, -1)), [b"one two"] * 400, 400, 800)
    assert every.search([b"one", b"two"], [5, 5], 3)[0].tolist() == [1, 2, 3]


def _mined(rows, anchor_every=50, positives=5, negatives_=3):
    good = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, (i, v, label) in enumerate(good):
        if i % anchor_every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, other) for b, (j, w, other) in enumerate(good) if b != a]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            inside = sorted(x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)
            out += [(i, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(inside[:negatives_])]
    return sorted(out)


@pytest.mark.parametrize("tile", [16_384, 50])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(negatives, "TILE_ROWS", tile)
    monkeypatch.setattr(negatives, "SCORES", 64)
    rng = random.Random(tile)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)], rng.randrange(4)) for i in range(600)]
    # hot copies and ties, a label of one row, anchors without positives, shorter and empty vectors, nulls and non-finite components
    rows += [(1000 + i, [0.5] * 6, i % 2) for i in range(200)] + [(2000, [0.5] * 6, 9), (2050, [0.1, 0.2], 1), (2051, [], 1), (2100, [], 2)]
    rows += [(2150, None, 1), (2151, [None] * 6, 1), (2152, [float("nan")] * 6, 1), (2153, [float("-inf")] * 6, 1), (2154, [0.1] * 6, None), (None, [0.5] * 6, 1), (50, [0.4] * 6, 1), (3, rows[3][1], 2)]
    rows += [(2201, [1e12] * 6, 3), (2203, [-1e6] * 6, 3)]
    frame = spark.createDataFrame([(*r, *PAD) for r in rows], "vec_id long, embedding array<double>, label int" + EXTRA).repartition(3)
    got = sorted(map(tuple, negatives.hard_negatives(frame).collect()))
    assert got == _mined(rows) and len(got) > 100
    assert negatives.hard_negatives(frame.where("false")).count() == 0
    assert negatives.hard_negatives(frame.where("vec_id = 2000")).count() == 0


def test_products_beyond_float64():
    a, b = np.array([[1 << 30, 3]]), np.array([[(1 << 30) + 1, 1]])
    assert negatives.products(a, b).tolist() == [[(1 << 60) + (1 << 30) + 3]]
    with pytest.raises(OverflowError):
        negatives.products(np.array([[1 << 40]]), np.array([[1 << 40]]))


@pytest.mark.parametrize("values", [[0], [5], [0, 0, 0], [7] * 1000, [0, 2**64 - 1], list(range(1000)), [2**63 + i * 12345 for i in range(700)], []])
def test_elias_fano_round_trip(values):
    coded = token_files.EliasFano.encode(np.array(values, np.uint64))
    read = token_files.EliasFano.read(coded.n, coded.low_bits, coded.parts())
    assert [int(x) for block in read for x in block] == values
    assert all(read[i] == values[i] for i in range(0, len(values), max(1, len(values) // 50)))
    with pytest.raises(IndexError):
        read[len(values)]


def test_elias_fano_is_small():
    rng = np.random.default_rng(1)
    values = np.cumsum(rng.integers(0, 2000, 300_000)).astype(np.uint64)
    coded = token_files.EliasFano.encode(values)
    assert 8 * sum(map(len, coded.parts())) < len(values) * (2.2 + math.log2(int(values[-1]) / len(values)))
    assert coded.samples.dtype == np.uint32


def _library():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return path, found


def test_pieces_equal_the_library():
    """Texts of random characters, white space of every kind beside spaces among them, by one encoder that remembers pieces."""
    path, library = _library()
    rng = random.Random(4)
    signs = [" ", " ", "  ", "\n", "\t", " ", " ", "　", "\u0085", " ", " ", "\x1c", "a", "bc", "é", "ß", "Ж", "中", "你好", "😀", "'s", "'ll", "n't", "12", "!", "--", "<|endoftext|>", "the", "ing", "â", "́", "ਅ", "ᚅ"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(0, 40))) for _ in range(3000)] + ["", " ", "x" * 5000, " ".join("word" for _ in range(3000)), None, "a" * 70 + " " + "b" * 70]
    coder = token_files.PieceEncoder(path)
    for _ in range(2):
        for a in range(0, len(texts), 250):
            part = texts[a : a + 250]
            ids, sizes = coder.encode(pa.array(part, pa.string()))
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [e.ids for e in library.encode_batch([t or "" for t in part], add_special_tokens=False)]


def test_piece_memory_is_bounded(monkeypatch):
    path, library = _library()
    monkeypatch.setattr(token_files, "PIECES", 5)
    coder = token_files.PieceEncoder(path)
    for text in ("one two three four five six seven eight", "one nine two ten", "seven " + "y" * 100 + " one"):
        ids, _ = coder.encode(pa.array([text]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(coder.known) == 5 and len(coder.begin) == 6 and coder.begin[-1] == len(coder.flat)


@pytest.mark.parametrize("shard_ids,shard_docs", [(1 << 25, 1 << 20), (40, 1 << 20), (1 << 25, 3)])
def test_token_files(spark, monkeypatch, shard_ids, shard_docs):
    from quarry.llm._common import new_path

    path, library = _library()
    monkeypatch.setattr(token_files, "SHARD_IDS", shard_ids)
    monkeypatch.setattr(token_files, "SHARD_DOCS", shard_docs)
    rows = [(i * 7 - 100, t) for i, t in enumerate(["", None, " \n ", "Short one.", "ümlaut ñandú 中文 😀", "x <|endoftext|> y", "long " * 40_000, "Short one."] * 4)]
    rows += [(None, "no id"), (None, None), (-(2**63), "least"), (2**63 - 1, "most"), (34, "a"), (34, "a"), (34, "b")]
    frame = spark.createDataFrame([(*r, *PAD) for r in rows], "doc_id long, text string" + EXTRA).repartition(3)
    folder = new_path(spark, "tokens")
    manifest = token_files.write_token_files(frame, path, folder)
    got = sorted(map(tuple, token_files.read_token_files(manifest, folder).collect()), key=lambda r: r[1])
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [0]
    want = Counter((d, tuple(ids(t))) for d, t in rows)
    assert Counter((r[0], tuple(r[4])) for r in got) == want
    order = [(r[0] is not None, r[0] or 0) for r in got]
    assert order == sorted(order)
    at = 0
    for _, start, n, crc, found in got:
        assert (start, n, crc) == (at, len(found), zlib.crc32(np.array(found, "<u4").tobytes()))
        at += n
    # single documents by select
    shards = manifest.orderBy("shard").collect()
    assert [s["start"] for s in shards] == np.cumsum([0, *[s["ids"] for s in shards]])[:-1].tolist()
    flat = iter(got)
    for s in shards:
        shard = token_files.TokenShard(folder, s["name"])
        assert shard.docs == s["docs"] <= shard_docs
        for i in range(shard.docs):
            r = next(flat)
            assert shard.doc_id(i) == r[0] and shard.document(i).tolist() == r[4] and shard.bounds[i] + s["start"] == r[1]
    assert token_files.token_files_roundtrip(frame.where("false"), path).count() == 0
    assert token_files.token_files_roundtrip(frame.where("doc_id = 34"), path).agg(F.sum("n_tokens")).first()[0] == 6


def test_token_files_that_are_cut_off_raise(spark):
    from quarry.llm._common import new_path
    from quarry.llm.warc import open_shared

    path, _ = _library()
    folder = new_path(spark, "tokens")
    frame = spark.createDataFrame([(1, "some words"), (2, "and more of them")], "doc_id long, text string")
    manifest = token_files.write_token_files(frame.coalesce(1), path, folder)
    name = manifest.orderBy(F.desc("shard")).first()["name"]
    with open_shared(f"{folder}/{name}.ids", "rb") as f:
        whole = f.read()
    with open_shared(f"{folder}/{name}.ids", "wb") as f:
        f.write(whole[:-1])
    with pytest.raises(Exception):
        token_files.read_token_files(manifest, folder).collect()
