"""Language identification by interpolated Kneser-Ney character models.

A model per language is fitted on a bounded sample of labelled texts. All models share sorted arrays of n-gram
hashes; beside each hash stand the log probabilities that the languages give it, and beside each context hash
the log weights by which they fall back. A text's n-grams are sorted, looked up once each in the arrays, and
summed by text. The language with the lowest cross-entropy a character wins; a text whose cross-entropy lies
beyond what calibration texts of that language show is marked as rejected.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm._common import arrow_batches, slices

ORDER = 4
#: Bytes of text that are scored at a time; a byte takes about a hundred while it is.
SCORE_BYTES = 1 << 18
#: The fitting sample: documents of a language (about), and code points of a language.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 1_500_000
#: Every tenth document of the sample calibrates rejection and is not fitted.
CALIBRATE = 10
#: Odd multipliers of the hashes.
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Hashes have 44 bits, so that a text's number fits below them.
LOW = np.uint64(20)
SENTINEL = 0x110000


@functools.cache
def letters() -> np.ndarray:
    """By code point: the lower-case code point of a letter, else 0."""
    table = np.zeros(SENTINEL + 1, np.uint32)
    for i in range(SENTINEL):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, text numbers, positions to score) of texts: letters, a 0 for each run of anything else, ORDER - 1 zeros before each text."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    pad = np.full(ORDER - 1, SENTINEL, np.uint32)
    joined = np.concatenate([x for r in raw for x in (pad, r)]) if raw else np.zeros(0, np.uint32)
    of = np.repeat(np.arange(len(texts)), [len(r) + ORDER - 1 for r in raw])
    code = letters()[joined]
    pads = joined == SENTINEL
    keep = (code != 0) | pads
    keep[1:] |= code[:-1] != 0
    code, of = code[keep], of[keep]
    return code.astype(np.uint64), of, np.flatnonzero(~pads[keep])


def ngram_hashes(code: np.ndarray) -> list[np.ndarray]:
    """For j from 1 to ORDER: 44-bit hashes of the j codes that end at each position."""
    out, f = [], code + np.uint64(1)
    for j in range(ORDER):
        if j:
            last = np.concatenate((np.zeros(1, np.uint64), f[:-1]))
            f = last * M1 + code + np.uint64(1)
        out.append(((f ^ (f >> np.uint64(29))) * M2) >> LOW)
    return out


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, whether found) of wanted in sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class LanguageModel:
    langs: list[str]
    #: By order: sorted hashes, and log2 probabilities (hashes x languages).
    keys: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    #: By order from 2: sorted context hashes, and log2 fall-back weights.
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    unseen: np.ndarray | None = None
    #: Per language: mean cross-entropy, deviation of a character, slack.
    normal: np.ndarray | None = None

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(summed log2 probabilities by text and language, scored characters by text)."""
        code, of, at = symbols(texts)
        hashes = ngram_hashes(code)
        n = np.bincount(of[at], minlength=len(texts))
        total = np.zeros((len(texts), len(self.langs)))
        # sorted by hash, each distinct n-gram is looked up once
        packed = np.sort((hashes[-1][at] << LOW) | of[at].astype(np.uint64))
        key = packed >> LOW
        fresh = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        where, there = find(self.keys[-1], key[fresh])
        counts = np.diff(np.append(np.flatnonzero(fresh), len(key)))
        row = np.repeat(np.where(there, where, -1), counts)
        text = (packed & np.uint64((1 << 20) - 1)).astype(np.int64)
        hit = row >= 0
        row, text = row[hit], text[hit]
        for k in range(len(self.langs)):
            total[:, k] = np.bincount(text, self.logp[-1][row, k], len(texts))
        if not hit.all():
            lost = at[~find(self.keys[-1], hashes[-1][at])[1]]
            self._fall_back(hashes, of, lost, total)
        return total, n

    def _fall_back(self, hashes, of, at, total) -> None:
        carried = np.zeros((len(at), len(self.langs)))
        for j in range(ORDER - 1, 0, -1):
            where, there = find(self.contexts[j - 1], hashes[j - 1][at - 1])
            carried += np.where(there[:, None], self.weights[j - 1][where] if len(self.contexts[j - 1]) else 0.0, 0.0)
            where, there = find(self.keys[j - 1], hashes[j - 1][at])
            if there.any():
                carried[there] += self.logp[j - 1][where[there]]
                for k in range(len(self.langs)):
                    total[:, k] += np.bincount(of[at[there]], carried[there, k], len(total))
            at, carried = at[~there], carried[~there]
        carried += self.unseen
        for k in range(len(self.langs)):
            total[:, k] += np.bincount(of[at], carried[:, k], len(total))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score from 0 to 1, cross-entropy, rejected) of each text."""
        given = [t or "" for t in texts]
        has = np.array([any(map(str.isalpha, t[:200])) or any(map(str.isalpha, t)) for t in given], bool)
        if not self.langs:
            none = np.zeros(len(texts))
            return ["und"] * len(texts), none, none, np.ones(len(texts), bool)
        total, n = self.score(given)
        cross = -total / np.maximum(n, 1)[:, None]
        best = cross.argmin(axis=1)
        # a posterior in which a long text counts as twenty characters, as characters are no independent evidence
        odds = np.exp2((cross.min(axis=1)[:, None] - cross) * np.minimum(n, 20)[:, None])
        score = np.where(has, 1 / odds.sum(axis=1), 0.0)
        h = cross[np.arange(len(best)), best]
        mean, dev, slack = self.normal[best].T
        rejected = ~has | (h > mean + 4 * dev / np.sqrt(np.maximum(n, 1)) + slack)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, has)], score, np.where(has, h, 0.0), rejected


def fit(samples: dict[str, list[str]]) -> LanguageModel:
    """Models of the languages of samples. A character of its own probability is kept for what no text has."""
    langs = sorted(samples)
    model = LanguageModel(langs)
    if not langs:
        return model
    fitted = {x: [t for i, t in enumerate(samples[x]) if len(samples[x]) < CALIBRATE or i % CALIBRATE] for x in langs}
    counts, alphabet = [], set()
    for lang in langs:
        code, _, at = symbols(fitted[lang])
        hashes = ngram_hashes(code)
        alphabet.update(np.unique(code[at]).tolist())
        tables: list[dict] = [{} for _ in range(ORDER)]
        where = at
        for j in range(ORDER - 1, -1, -1):
            # the top order counts places, a lower one the distinct longer n-grams that end alike
            key, first, n = np.unique(hashes[j][where], return_index=True, return_counts=True)
            where = where[first]
            once, twice = (n == 1).sum(), (n == 2).sum()
            d = once / (once + 2 * twice) if once and twice else 0.5
            context = hashes[j - 1][where - 1] if j else np.zeros(len(key), np.uint64)
            names, inverse = np.unique(context, return_inverse=True)
            tables[j] = {"key": key, "n": n, "d": d, "context": context, "suffix": hashes[j - 1][where] if j else None, "contexts": names, "sum": np.bincount(inverse, n), "kinds": np.bincount(inverse)}
        counts.append(tables)
    size = len(alphabet) + 1
    lower = None
    floor = np.zeros(len(langs))
    for j in range(ORDER):
        keys, first = np.unique(np.concatenate([t[j]["key"] for t in counts]), return_index=True)
        context = np.concatenate([t[j]["context"] for t in counts])[first]
        suffix = np.concatenate([t[j]["suffix"] for t in counts])[first] if j else None
        p = np.zeros((len(keys), len(langs)))
        contexts = np.unique(np.concatenate([t[j]["contexts"] for t in counts]))
        weights = np.zeros((len(contexts), len(langs)), np.float32)
        for k, tables in enumerate(counts):
            t = tables[j]
            below = np.full(len(keys), 1 / size) if not j else lower[find(model.keys[j - 1], suffix)[0], k]
            at, there = find(t["key"], keys)
            n = np.where(there, t["n"][at], 0) if len(t["key"]) else np.zeros(len(keys))
            at, seen = find(t["contexts"], context)
            if len(t["contexts"]):
                total, kinds = t["sum"][at], t["kinds"][at]
                p[:, k] = np.where(seen, np.maximum(n - t["d"], 0) / total + t["d"] * kinds / total * below, below)
                at, seen = find(t["contexts"], contexts)
                back = t["d"] * t["kinds"][at] / t["sum"][at]
                weights[:, k] = np.where(seen, np.log2(back), 0)
            else:
                p[:, k] = below
            if not j:
                floor[k] = (t["d"] * t["kinds"][0] / t["sum"][0] if len(t["sum"]) else 1.0) / size
        model.keys.append(keys)
        model.logp.append(np.log2(p).astype(np.float32))
        lower = p
        if j:
            model.contexts.append(contexts)
            model.weights.append(weights)
    model.unseen = np.log2(floor)
    model.normal = np.zeros((len(langs), 3))
    for k, lang in enumerate(langs):
        texts = [t for t in samples[lang][:: CALIBRATE if len(samples[lang]) >= CALIBRATE else 1] if any(map(str.isalpha, t))]
        if not texts:
            model.normal[k] = (0, 0, np.inf)
            continue
        total, n = model.score(texts)
        h = -total[:, k] / n
        mean = h @ n / n.sum()
        dev = np.sqrt(np.median((h - mean) ** 2 * n)) + 1e-9
        # no calibration text is beyond it, and as much again is left
        slack = max(1.0, 2 * float((h - mean - 4 * dev / np.sqrt(n)).max()))
        model.normal[k] = (mean, dev, slack)
    return model


def training_rows(docs: DataFrame, id_col: str, modulus: int = 3, held_out: int = 1):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) != held_out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> LanguageModel:
    """Fits on about sample_docs labelled documents of each language, chosen by a hash of id and text, sample_chars code points at most.

    Both bounds hold on the executors, before anything is collected: documents are taken in order of their hash
    until a language has its code points, and the last one is cut there. Rows that repeat id and text count
    once; rows without an id are drawn by their texts. The sample is all that reaches the driver. Documents held
    out by training_rows() never do.
    """
    rows = docs.where(training_rows(docs, id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    key = F.xxhash64(F.lit("sample"), F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    rows = rows.select(key.alias("key"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return fit({})
    rate = F.element_at(F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(min(1.0, sample_docs / v)))]), F.col("lang"))
    drawn = rows.where(F.pmod("key", F.lit(1 << 30)) < rate * (1 << 30)).groupBy("lang", "key").agg(F.min(F.substring("text", 1, sample_chars)).alias("text"))
    before = F.coalesce(F.sum(F.char_length("text")).over(Window.partitionBy("lang").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounded = drawn.withColumn("before", before).where(F.col("before") < sample_chars)
    samples: dict[str, list[str]] = {k: [] for k in n}
    for r in bounded.select("lang", "key", F.substring("text", F.lit(1), (F.lit(sample_chars) - F.col("before")).cast("int")).alias("text")).orderBy("lang", "key").collect():
        samples[r["lang"]].append(r["text"])
    return fit(samples)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """One row per input row: id_col, the columns of keep, and lang_pred, score, cross_entropy, rejected, with prefix before these names.

    lang_pred is a language of the model, or und (rejected, score 0) if the text is null or has no letter;
    ties go to the first language by name. Whole texts are scored, of any length, in bounded slices. Repeated
    rows score alike; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    picked = docs.select(F.col(text_col).cast("string").alias("__text"), F.col(id_col).alias("__id"), *[F.col(c) for c in keep])
    names = picked.columns[1:]
    new = [prefix + x for x in ("lang_pred", "score", "cross_entropy", "rejected")]
    added = [T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*picked.schema[1:], *[T.StructField(n, t) for n, t in zip(new, added)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist()
            for a, b in slices(sizes, SCORE_BYTES):
                part = batch.slice(a, b - a)
                lang, score, cross, rejected = known.predict(part.column(0).to_pylist())
                found = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(cross, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *found], names=[*names, *new])

    return picked.mapInArrow(run, schema).withColumnRenamed("__id", id_col)
