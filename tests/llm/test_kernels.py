"""The Python kernels of the training-data operators against plain definitions."""

import io
import json
import math
import random
import zlib

import numpy as np
import pytest
import xxhash

from quarry.llm import bm25, bpe, langid, maxent, simhash, substring_dedup, warc


def test_bpe_equals_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    own, library = bpe.ByteBpe(path), tokenizers.Tokenizer.from_file(path)
    random.seed(1)
    letters = " \t\n\r\x0b\x1c\x85　ab'sẞéñ1²½中😀‍.,!-_\x00"
    texts = ["", None, " ", "a" * 2000, "<|endoftext|>", "x <|endoftext|> y"]
    texts += ["".join(random.choice([random.choice(letters), "<|endoftext|>" if random.random() < 0.1 else "'re", "  "]) for _ in range(random.randint(0, 12))) for _ in range(3000)]
    for t in texts:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert own.encode(t) == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False) == (t or "")


def test_bpe_long_word_equals_scan():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    own = bpe.ByteBpe(path)
    random.seed(2)
    word = "".join(random.choice("abcdeéñ") for _ in range(700)).encode()
    assert own.merge(word) == own.long_word(word)


def test_simhash_majority_and_shingles():
    def brute(text):
        w = text.encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    texts = ["", "a", "A b", "a b c", " ".join(str(i % 7) for i in range(600)), "x y z " * 300]
    found = [[xxhash.xxh64_intdigest(s, seed=42) for s in simhash.shingles(t.encode(), 3)] for t in texts]
    got = simhash.majority(np.array([h for x in found for h in x], np.uint64), np.array([len(x) for x in found]))
    assert [int(g) for g in got] == [brute(t) for t in texts]


def _labels(links, n):
    label = list(range(n))
    while True:
        new = label[:]
        for i, j in links:
            new[i] = new[j] = min(new[i], new[j])
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("size", [1, 5, 120, 700])
def test_simhash_tiles_keep_components(size):
    rng = np.random.default_rng(size)
    base = rng.integers(0, 2**63, size, dtype=np.uint64)
    a = np.unique(np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, size).astype(np.uint64))]))
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 2
    want = _labels([tuple(x) for x in np.argwhere(near)], len(a))
    x, y = simhash.tile_links(a, None, 2)
    at = {v: i for i, v in enumerate(a.tolist())}
    assert len(x) < len(a)
    assert _labels([(at[p], at[q]) for p, q in zip(x.tolist(), y.tolist())], len(a)) == want


def test_warc_normaliser_round_trip():
    payloads = [b"", b"<p>x</p>", b"\r\n\r\nWARC/1.1\r\n", bytes(range(256)) * 9000]
    records = [warc.record_bytes("response", str(i), f"http://x/{i}\r\nEvil: 1", warc.payload_digest(p), p) for i, p in enumerate(payloads)]
    raw, out, index = io.BytesIO(), io.BytesIO(), io.BytesIO()
    warc.write_monolithic(records, raw)
    raw.seek(0)
    assert warc.normalise(raw, out, index) == len(payloads)
    for i, line in enumerate(map(json.loads, index.getvalue().splitlines())):
        heads, payload = warc.read_at(out.getvalue(), line["offset"], line["length"])
        assert payload == payloads[i] and heads["x-page-id"] == str(i) and "evil" not in heads
        assert zlib.decompress(out.getvalue()[line["offset"] : line["offset"] + line["length"]], 31) == records[i]
    cut = io.BytesIO(raw.getvalue()[:-20])
    with pytest.raises(Exception):
        warc.normalise(cut, io.BytesIO(), io.BytesIO())


def test_language_model_is_kneser_ney():
    """Scores equal a dictionary version of the same interpolation, and probabilities add up to one."""
    samples = {"a": ["der hund und die katze", "ein haus am see", "und der see"], "b": ["the cat and the dog", "a house by the lake", "and the lake"]}
    model = langid.fit(samples)
    total, n = model.score(["the lake", "und die katze"])
    assert total[0, 1] > total[0, 0] and total[1, 0] > total[1, 1] and list(n) == [8, 13]

    def grams(lang):
        seqs = [[0] * 3 + [int(c) for c in langid.symbols([t])[0][3:]] for t in samples[lang]]
        top = {}
        for s in seqs:
            for i in range(3, len(s)):
                g = tuple(s[i - 3 : i + 1])
                top[g] = top.get(g, 0) + 1
        tables = [top]
        while len(tables) < 4:
            low = {}
            for g in tables[-1]:
                low[g[1:]] = low.get(g[1:], 0) + 1
            tables.append(low)
        return tables[::-1], {c for s in seqs for c in s[3:]}

    parts = {x: grams(x) for x in samples}
    size = len(set().union(*(p[1] for p in parts.values()))) + 1

    def prob(lang, g):
        tables = parts[lang][0]
        if not g[:-1] and not g:
            return 1 / size
        t = tables[len(g) - 1]
        once, twice = sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())
        d = once / (once + 2 * twice) if once and twice else 0.5
        same = {k: v for k, v in t.items() if k[:-1] == g[:-1]}
        below = prob(lang, g[1:]) if len(g) > 1 else 1 / size
        if not same:
            return below
        return max(t.get(g, 0) - d, 0) / sum(same.values()) + d * len(same) / sum(same.values()) * below

    code = [0] * 3 + [int(c) for c in langid.symbols(["the lake xyz"])[0][3:]]
    for k, lang in enumerate(["a", "b"]):
        want = sum(math.log2(prob(lang, tuple(code[i - 3 : i + 1]))) for i in range(3, len(code)))
        assert model.score(["the lake xyz"])[0][0, k] == pytest.approx(want, rel=1e-4)

    # predictions, scores and rejections from the plain cross-entropies
    model.normal = np.array([[2.0, 0.5, 1.0], [2.2, 0.4, 0.1]])
    texts = ["the lake", "und die katze", "the lake xyz qqq zzz", "1 2 3", None, "haus", "w" * 40]
    lang, score, cross, rejected = model.predict(texts)
    for j, t in enumerate(texts):
        if not any(map(str.isalpha, t or "")):
            assert (lang[j], score[j], cross[j], rejected[j]) == ("und", 0, 0, True)
            continue
        code = [0] * 3 + [int(c) for c in langid.symbols([t])[0][3:]]
        n = len(code) - 3
        h = [-sum(math.log2(prob(x, tuple(code[i - 3 : i + 1]))) for i in range(3, len(code))) / n for x in ("a", "b")]
        best = h.index(min(h))
        assert lang[j] == "ab"[best] and cross[j] == pytest.approx(h[best], rel=1e-4)
        assert score[j] == pytest.approx(1 / sum(2 ** ((h[best] - x) * min(n, 20)) for x in h), rel=1e-3)
        mean, dev, slack = model.normal[best]
        assert rejected[j] == (h[best] > mean + 4 * dev / math.sqrt(n) + slack)
    assert rejected.any() and not rejected.all()


def test_language_edges():
    model = langid.fit({"a": ["hallo welt"], "b": ["hello world"]})
    lang, score, _, rejected = model.predict([None, "", "123 !!", "hello world"])
    assert lang[:3] == ["und"] * 3 and lang[3] == "b" and list(rejected[:3]) == [True] * 3
    assert all(0 <= s <= 1 for s in score)
    assert langid.fit({}).predict(["x"])[0] == ["und"]


def test_window_hashes_and_minimum():
    rng = np.random.default_rng(3)
    w = rng.integers(0, 2**63, 300, dtype=np.uint64)
    w[150:210] = w[20:80]
    h = substring_dedup.run_hashes(w, 50)
    assert len(h) == 251 and (h[150:161] == h[20:31]).all() and len(np.unique(h)) == 240
    v = rng.integers(0, 99, 77)
    for width in (1, 2, 7, 41, 77):
        assert substring_dedup.sliding_min(v, width).tolist() == [v[i : i + width].min() for i in range(77 - width + 1)]


def test_shard_search_is_exact():
    random.seed(4)
    vocab = [f"w{i}" for i in range(60)]
    texts = [" ".join(random.choices(vocab, weights=[1 / (i + 1) for i in range(60)], k=random.randint(0, 40))).encode() for _ in range(500)]
    shard, worked = bm25.Shard(list(range(500)), texts, 20.0, 1.2, 0.75), 0
    for q in texts[:40]:
        want = {t: random.random() for t in set(bm25.terms(q))}
        hashes = np.array([bm25._hash(t) for t in want], np.uint64)
        ids, scores, scored = shard.search(hashes, np.array(list(want.values())), 7)
        worked += scored
        brute = []
        for d, text in enumerate(texts):
            tf = {t: bm25.terms(text).count(t) for t in set(bm25.terms(text)) & set(want)}
            if tf:
                n = len(bm25.terms(text))
                brute.append((-round(sum(want[t] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / 20.0)) for t, f in tf.items()), 6), d))
        brute = sorted(brute)[:7]
        assert np.allclose(scores, [-s for s, _ in brute], atol=2e-6)
        assert ids.tolist() == [d for _, d in brute]
    # list and block maxima spare most documents
    assert worked < 0.6 * 40 * 500


def test_maxent_probabilities_add_up():
    rng = np.random.default_rng(5)
    w = maxent.Weights(rng.normal(size=maxent.CLASSES).astype("f4"), rng.normal(size=(maxent.ROWS, maxent.CLASSES)).astype("f4"), rng.normal(size=(maxent.HEAD, maxent.WIDTH)).astype("f4"), rng.normal(size=(maxent.ROWS, maxent.WIDTH)).astype("f4"))
    norm = np.zeros(maxent.TAIL)
    every = np.arange(maxent.FREQUENT + maxent.TAIL)
    total = 0.0
    for last in every:
        ids = np.array([5, 9, last], np.uint16)
        total += 10 ** maxent.place_scores(w, norm, ids, np.array([0]))[2]
    assert total == pytest.approx(1.0, rel=1e-3)
    # expected counts of a piece equal the sum of its places' probabilities
    texts = [rng.integers(0, maxent.FREQUENT + maxent.TAIL, 50).astype(np.uint16) for _ in range(4)]
    expected = maxent.gradient(w, iter(texts))
    assert expected[:, : maxent.CLASSES].sum() == pytest.approx(3 * 200, rel=1e-3)
    observed = maxent.gradient(None, iter(texts))
    assert observed[:, : maxent.CLASSES].sum() == 600
    # observed less expected counts are the derivative of the log likelihood: single weights moved a little
    likelihood = lambda: math.log(10) * sum(maxent.place_scores(w, np.zeros(maxent.TAIL), t, np.array([0])).sum() for t in texts)
    g = observed.astype(float) - expected
    for at in [*zip(*np.unravel_index(np.argsort(-np.abs(g), axis=None)[:6], g.shape)), *zip(*np.nonzero(expected[:, maxent.CLASSES :] > 0.2))][:20]:
        row, col = int(at[0]), int(at[1])
        table, c = (w.table1, col) if col < maxent.CLASSES else (w.table2, col - maxent.CLASSES)
        table[row, c] += 0.05
        up = likelihood()
        table[row, c] -= 0.1
        down = likelihood()
        table[row, c] += 0.05
        assert (up - down) / 0.1 == pytest.approx(g[row, col], abs=0.03)


def test_places_of_long_texts(monkeypatch):
    """More places than fit beside a key are sorted apart, with the same result."""
    key = np.random.default_rng(3).integers(0, 1 << 38, 50, dtype=np.uint64)[np.arange(400) % 50]
    want = maxent._by_key(key)
    monkeypatch.setattr(maxent, "PLACE_BITS", 4)
    for a, b in zip(want, maxent._by_key(key)):
        assert a.tolist() == b.tolist()
