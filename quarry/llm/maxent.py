"""A hashed maximum-entropy language model with a class-factored softmax.

A token's probability is that of its class given the two tokens before it, times that of the token within its
class. Frequent tokens have classes of equal size and a second softmax; all others fall into classes by their
last letters and share their class by count. Features (the token before, the one before that, and both) are
hashed to rows of weights. Training is gradient ascent on the log likelihood of all training tokens: every task
sums the gradient's two halves, observed and expected counts of each weight, over its documents in sparse
numpy batches; the sums are added up by block, and each weight moves along its gradient, observed less expected,
over the mean of both, which is the scale of its curvature and keeps any step bounded.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import arrow_batches, slices, staged

#: Classes of frequent tokens, of other tokens, tokens in a class of the first kind, rows of each weight table.
HEAD, TAIL, WIDTH, ROWS = 32, 32, 64, 1 << 14
CLASSES = HEAD + TAIL
#: Ids: below FREQUENT a frequent token; then a class of others; then the start of a text.
FREQUENT = HEAD * WIDTH
START = FREQUENT + TAIL
#: Tokens whose counts every worker holds; counts of all others come by a join.
COUNTED = 1 << 18
#: The end of a text, which no word equals.
END = b""
SMOOTH, STEP = 0.5, 0.5
BLOCKS = 32
BATCH = 8192
#: Tokens that a task sums at a time, and in all, about.
PIECE, TASK = 1 << 21, 1 << 25


def tokens(text: bytes | None) -> list[bytes]:
    """Words, A-Z lower-cased, then one end."""
    words = (text or b"").lower().split()
    words.append(END)
    return words


def tail_class(token: bytes) -> int:
    return zlib.crc32(token[-3:]) % TAIL


@dataclass
class Vocabulary:
    """What the whole training corpus has counted, as far as workers hold it."""

    total: int
    distinct: int
    index: dict[bytes, int]
    count: np.ndarray
    ident: np.ndarray
    #: By class of other tokens: log10 of the sum of (count + 1), and one for what was never seen.
    tail_norm: np.ndarray

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(ids, places in the index or -1, words outside the index in order)."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        ids = np.where(at >= 0, self.ident[at], 0).astype(np.uint16)
        out = np.flatnonzero(at < 0)
        rare = [words[i] for i in out.tolist()]
        ids[out] = [FREQUENT + tail_class(w) for w in rare]
        return ids, at, rare


@dataclass
class Weights:
    bias1: np.ndarray  # CLASSES
    table1: np.ndarray  # ROWS x CLASSES
    bias2: np.ndarray  # HEAD x WIDTH
    table2: np.ndarray  # ROWS x WIDTH


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(40)).astype(np.int64) % ROWS


def contexts(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The two ids before each place as one number, for texts laid end to end; starts: where each begins."""
    one = np.concatenate(([START], ids[:-1])).astype(np.uint64)
    one[starts] = START
    two = np.concatenate(([START], one[:-1])).astype(np.uint64)
    two[starts] = START
    return one << np.uint64(16) | two


def rows_of(context: np.ndarray, klass: np.ndarray | None = None) -> list[np.ndarray]:
    """Rows of the first table for each context; with classes of frequent tokens, of the second, where each class has rows of its own."""
    one, two = context >> np.uint64(16), context & np.uint64(0xFFFF)
    first, second = one * np.uint64(4) + np.uint64(1), two * np.uint64(4) + np.uint64(2)
    if klass is None:
        return [_mix(first), _mix(second), _mix(context * np.uint64(4) + np.uint64(3))]
    own = ROWS // HEAD
    return [klass * own + _mix(x) % own for x in (first, second)]


def classes(ids: np.ndarray) -> np.ndarray:
    ids = ids.astype(np.int64)
    return np.where(ids < FREQUENT, ids // WIDTH, ids - FREQUENT + HEAD)


def softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _class_probabilities(w: Weights, rows: list[np.ndarray]) -> np.ndarray:
    logits = w.table1[rows[0]]
    for r in rows[1:]:
        logits += w.table1[r]
    logits += w.bias1
    return softmax(logits)


def _token_probabilities(w: Weights, klass: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    logits = w.table2[rows[0]]
    for r in rows[1:]:
        logits += w.table2[r]
    logits += w.bias2[klass]
    return softmax(logits)


def _scatter(total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    if len(rows):
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        cuts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        total[rows[cuts]] += np.add.reduceat(values[order], cuts, axis=0)


def gradient(w: Weights | None, texts: Iterator[np.ndarray]) -> np.ndarray:
    """Observed or, with weights, expected counts of every weight over texts: ROWS x (CLASSES + WIDTH).

    Places with the same context expect the same, so each distinct context of a piece is worked once.
    """
    total1, total2 = np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, WIDTH), np.float32)
    counts1, counts2 = np.zeros(ROWS * CLASSES), np.zeros(ROWS * WIDTH)
    for ids, starts in joined(texts, PIECE):
        context = contexts(ids, starts)
        at = np.flatnonzero(ids < FREQUENT)
        klass = ids[at].astype(np.uint64) // np.uint64(WIDTH)
        if w is None:
            k = classes(ids)
            for r in rows_of(context):
                counts1 += np.bincount(r * CLASSES + k, minlength=len(counts1))
            for r in rows_of(context[at], klass.astype(np.int64)):
                counts2 += np.bincount(r * WIDTH + ids[at] % WIDTH, minlength=len(counts2))
            continue
        both, n2 = np.unique(klass << np.uint64(32) | context[at], return_counts=True)
        context, n1 = np.unique(context, return_counts=True)
        for s in range(0, len(context), BATCH):
            cut = slice(s, s + BATCH)
            rows = rows_of(context[cut])
            p = _class_probabilities(w, rows) * n1[cut, None].astype(np.float32)
            for r in rows:
                _scatter(total1, r, p)
        for s in range(0, len(both), BATCH):
            part = both[s : s + BATCH]
            klass = (part >> np.uint64(32)).astype(np.int64)
            rows = rows_of(part & np.uint64(0xFFFFFFFF), klass)
            p = _token_probabilities(w, klass, rows) * n2[s : s + BATCH, None].astype(np.float32)
            for r in rows:
                _scatter(total2, r, p)
    if w is None:
        total1, total2 = counts1.reshape(total1.shape), counts2.reshape(total2.shape)
    return np.concatenate((total1, total2), axis=1).astype(np.float32)


#: Bits of a place that are sorted along with its key.
PLACE_BITS = 26


def _by_key(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys of under 38 bits, places sorted by key, the distinct key's number at each of these)."""
    if len(key) >> PLACE_BITS:
        # a text of more tokens than places fit beside a key
        place = np.argsort(key, kind="stable")
        key = key[place]
    else:
        packed = np.sort(key << np.uint64(PLACE_BITS) | np.arange(len(key), dtype=np.uint64))
        place = (packed & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        key = packed >> np.uint64(PLACE_BITS)
    fresh = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    return key[fresh], place, np.cumsum(fresh) - 1


def place_scores(w: Weights, norm: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """By place: the log10 probability of its id."""
    out = np.zeros(len(ids))
    context = contexts(ids, starts)
    keys, place, number = _by_key(context)
    k = classes(ids)[place]
    for s in range(0, len(keys), BATCH):
        p = _class_probabilities(w, rows_of(keys[s : s + BATCH]))
        a, b = np.searchsorted(number, (s, s + BATCH))
        out[place[a:b]] = np.log10(np.maximum(p[number[a:b] - s, k[a:b]], 1e-30))
    at = np.flatnonzero(ids < FREQUENT)
    keys, place, number = _by_key((ids[at].astype(np.uint64) // np.uint64(WIDTH)) << np.uint64(32) | context[at])
    place = at[place]
    for s in range(0, len(keys), BATCH):
        part = keys[s : s + BATCH]
        klass = (part >> np.uint64(32)).astype(np.int64)
        p = _token_probabilities(w, klass, rows_of(part & np.uint64(0xFFFFFFFF), klass))
        a, b = np.searchsorted(number, (s, s + BATCH))
        out[place[a:b]] += np.log10(np.maximum(p[number[a:b] - s, ids[place[a:b]] % WIDTH], 1e-30))
    other = np.flatnonzero(ids >= FREQUENT)
    out[other] -= norm[ids[other].astype(np.int64) - FREQUENT]
    return out


def joined(texts: Iterator[np.ndarray], size: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts laid end to end in pieces of about size tokens, with their starts."""
    held, n = [], 0
    for t in chain(texts, [None]):
        if held and (t is None or n + len(t) > size):
            yield np.concatenate(held), np.cumsum([0, *map(len, held[:-1])])
            held, n = [], 0
        if t is not None and len(t):
            held.append(t)
            n += len(t)


def log_scores(w: Weights, norm: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """By text: the log10 probability of its ids, without the counts of tokens in classes by last letters."""
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    found = [place_scores(w, norm, ids, starts) for ids, starts in joined(iter(texts))]
    return np.bincount(of, np.concatenate(found), len(texts)) if found else np.zeros(len(texts))


def count_tokens(rows: DataFrame) -> DataFrame:
    """(token binary, n) over the training texts of rows(held, text), combined within batches and tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column(0):
                found.update(tokens(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["token", "n"])

    return rows.where(~F.col("held")).select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def build_vocabulary(counts: DataFrame) -> Vocabulary:
    """Takes the most frequent tokens, a fixed number, and the sums of all to the driver."""
    sums = counts.agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).first()
    # tokens by an eighth of a power of two of their count: a few hundred rows tell from which count on they fit
    sizes = counts.groupBy(F.floor(8 * F.log2(F.col("n").cast("double"))).alias("b")).agg(F.count("*").alias("k"), F.min("n").alias("least"))
    cut, room = None, COUNTED
    for r in sizes.orderBy(F.desc("b")).collect():
        room -= r["k"]
        if room < 0:
            break
        cut = r["least"]
    found = counts.where(F.col("n") >= (cut if cut is not None else 1 << 62)).toArrow()
    top = sorted(zip(found.column("token").to_pylist(), found.column("n").to_pylist()), key=lambda x: (-x[1], x[0]))
    frequent = {END: 0}
    for token, _ in top:
        if len(frequent) == FREQUENT:
            break
        frequent.setdefault(token, len(frequent))
    # frequent tokens by count, so that a class holds tokens of like frequency
    ident = [frequent[t] if t in frequent else FREQUENT + tail_class(t) for t, _ in top]
    norm = np.ones(TAIL)
    last = F.when(F.octet_length("token") < 3, F.col("token")).otherwise(F.substring("token", -3, 3))
    klass = F.pmod(F.crc32(last), F.lit(TAIL))
    for r in counts.groupBy(klass.alias("k")).agg(F.sum(F.col("n") + 1).alias("s")).collect():
        norm[r["k"]] += r["s"]
    for token, n in top:
        if token in frequent:
            norm[tail_class(token)] -= n + 1
    return Vocabulary(sums["total"] or 0, sums["distinct"], {t: i for i, (t, _) in enumerate(top)}, np.array([n for _, n in top] + [0], np.int64), np.array(ident + [0], np.uint16), np.log10(norm))


def encode(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(ord, held, n_tokens, n_known, base, tail, ids, rare, times) of rows(ord, held, text).

    base and tail sum log10(count + 1) of the tokens that workers hold, tail over those that are not frequent;
    rare and times are the others with how often the text has them.
    """
    shared = rows.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        logs = np.log10(v.count + 1.0)
        for batch in batches:
            n, known, base, tail, packed, rare, times = [], [], [], [], [], [], []
            for text in batch.column(2):
                words = tokens(text.as_py())
                ids, at, out = v.encode(words)
                held = at >= 0
                value = logs[at[held]]
                n.append(len(words))
                known.append(int(held.sum()))
                base.append(float(value.sum()))
                tail.append(float(value[ids[held] >= FREQUENT].sum()))
                packed.append(ids.tobytes())
                found = Counter(out)
                rare.append(list(found.keys()))
                times.append(list(found.values()))
            arrays = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(tail, pa.float64()), pa.array(packed, pa.binary()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *arrays], names=["ord", "held", "n_tokens", "n_known", "base", "tail", "ids", "rare", "times"])

    return rows.select("ord", "held", "text").mapInArrow(run, "ord long, held boolean, n_tokens long, n_known long, base double, tail double, ids binary, rare array<binary>, times array<long>")


def summed(encoded: DataFrame, weights: Weights | None, tokens_in_all: int) -> np.ndarray:
    """gradient() over all training texts: a sum per task, added up by block on the executors; only the total reaches the driver."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-tokens_in_all // TASK))
    slots = math.isqrt(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = gradient(shared.value, (np.frombuffer(x.as_buffer(), np.uint16) for batch in batches for x in batch.column(0)))
        slot = TaskContext.get().partitionId() % slots
        parts = [p.tobytes() for p in np.split(total, BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([slot] * BLOCKS, pa.int32()), pa.array(parts, pa.binary())], names=["block", "slot", "part"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(ROWS // BLOCKS * (CLASSES + WIDTH))
        for p in parts["part"]:
            total += np.frombuffer(p, np.float32)
        return parts.iloc[:1].assign(part=[total.astype(np.float32).tobytes()])

    kind = "block int, slot int, part binary"
    part = encoded.where(~F.col("held")).select("ids").coalesce(tasks).mapInArrow(run, kind)
    # by block and slot first, so that no group holds more than the root of all tasks' sums
    part = part.groupBy("block", "slot").applyInPandas(add, kind).groupBy("block").applyInPandas(add, kind)
    found = {r["block"]: r["part"] for r in part.collect()}
    shape = (ROWS // BLOCKS, CLASSES + WIDTH)
    return np.concatenate([np.frombuffer(found[b], np.float32).reshape(shape) if b in found else np.zeros(shape, np.float32) for b in range(BLOCKS)]).astype(np.float64)


def train(encoded: DataFrame, vocab: Vocabulary, rounds: int = 2) -> Weights:
    """Weights after a first update, which needs observed counts only, and so many rounds over all training texts."""
    observed = summed(encoded, None, vocab.total)
    share = observed[:, :CLASSES].sum(axis=0) / 3 + 1
    share /= share.sum()
    by_id = np.ones(FREQUENT)
    known = vocab.ident[:-1] < FREQUENT
    by_id[vocab.ident[:-1][known]] += vocab.count[:-1][known]
    within = by_id.reshape(HEAD, WIDTH)
    within = within / within.sum(axis=1, keepdims=True)
    w = Weights(np.log(share).astype(np.float32), np.zeros((ROWS, CLASSES), np.float32), np.log(within).astype(np.float32), np.zeros((ROWS, WIDTH), np.float32))
    for k in range(rounds + 1):
        if k:
            expected = summed(encoded, w, vocab.total)
        else:
            # without weights, a row expects its own total by the shares of the classes, or of the tokens of its class
            first, second = observed[:, :CLASSES], observed[:, CLASSES:]
            expected = np.concatenate((first.sum(axis=1, keepdims=True) * share, second.sum(axis=1, keepdims=True) * np.repeat(within, ROWS // HEAD, axis=0)), axis=1)
        step = STEP * (observed - expected) / ((observed + expected) / 2 + SMOOTH)
        w.table1 += step[:, :CLASSES].astype(np.float32)
        w.table2 += step[:, CLASSES:].astype(np.float32)
    return w


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held_out: int = 2, rounds: int = 2) -> DataFrame:
    """One row per input row: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from all rows whose crc32(id as text) mod modulus is not held_out. Null and empty texts are one end
    token. Ids are integers; a null id counts as the text ''. Repeated rows score alike and count each time.
    With no training row, base_score is 0 and the model knows its classes only. Other columns are not read;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == held_out
    rows = docs.select(F.col(id_col).cast("long").alias("ord"), held.alias("held"), F.col(text_col).cast("binary").alias("text"))
    counts = staged(count_tokens(rows), "counts")
    vocab = build_vocabulary(counts)
    encoded = staged(encode(rows, vocab).withColumn("row", F.monotonically_increasing_id()), "encoded")
    weights = train(encoded, vocab, rounds)

    # the counts of rare tokens come by a join
    asked = encoded.select("row", "rare", "times").where(F.size("rare") > 0)
    asked = asked.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", "x.rare", "x.times")
    key = lambda c: (F.xxhash64(c).alias("t1"), F.xxhash64(F.lit(1), c).alias("t2"))
    known = counts.select(*key("token"), "n")
    asked = asked.select("row", "times", *key("rare")).join(known, ["t1", "t2"])
    rare = asked.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_log"), F.sum("times").alias("rare_known"))
    rare = staged(rare, "rare")

    shared = spark.sparkContext.broadcast((weights, vocab.tail_norm))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, norm = shared.value
        for batch in batches:
            texts = [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(0)]
            model = np.zeros(len(texts))
            for a, b in slices([len(t) for t in texts], 1 << 20):
                model[a:b] = log_scores(w, norm, texts[a:b])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(model)], names=["ord", "row", "held", "n_tokens", "n_known", "base", "tail", "model"])

    scored = encoded.select("ids", "ord", "row", "held", "n_tokens", "n_known", "base", "tail")
    scored = scored.mapInArrow(run, "ord long, row long, held boolean, n_tokens long, n_known long, base double, tail double, model double")
    both = scored.join(rare, "row", "left")
    more = F.coalesce("rare_log", F.lit(0.0))
    return both.select(
        F.col("ord").cast(docs.schema[id_col].dataType).alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * math.log10(vocab.total + vocab.distinct + 1)).alias("base_score"),
        (F.col("model") + F.col("tail") + more).alias("score"),
    )
