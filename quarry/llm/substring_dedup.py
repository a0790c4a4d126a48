"""Substring dedup with a log-structured fingerprint index.

Every window of W words has a fingerprint: the least hash of its runs of K words, so that neighbouring windows
mostly share one and an index of them is some twenty times smaller than the windows. The index is a log of
sorted immutable runs of (fingerprint, document). A batch of documents is merge-joined with the runs, written
as a new run, and runs are compacted into one when there are many. Windows whose fingerprint another document
holds are then verified: their whole word sequences are compared by a 128-bit hash, on both sides, and only
then do words go. Documents that equal an earlier one as a whole need no index entry.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._common import arrow_batches, new_path, slices, staged
from quarry.llm.warc import open_shared

#: Odd multipliers of the rolling hashes, and those of their last step.
ROLL = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = np.uint64(0xD6E8FEB86659FD93)
MASK = (1 << 64) - 1
#: Words whose hash a worker remembers.
MEMORY = 400_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_known = _Words()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, k: int, kind: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of k word hashes: differences of prefix sums of h[i] * m**i, brought back to the run's start."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)

    def powers(base: int) -> np.ndarray:
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)

    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(ROLL[kind])[:n], out=sums[1:])
    out = (sums[k:] - sums[: n - k + 1]) * powers(pow(ROLL[kind], -1, MASK + 1))[: n - k + 1]
    out ^= out >> np.uint64(31)
    out *= MIX
    return out ^ (out >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, by doubling."""
    found, span = values, 1
    while 2 * span <= width:
        found = np.minimum(found[:-span], found[span:])
        span *= 2
    n = len(values) - width + 1
    return np.minimum(found[:n], found[width - span : width - span + n])


def window_fingerprints(hashes: np.ndarray, window: int, k: int) -> np.ndarray:
    """The fingerprint of each window of the words."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64)
    return sliding_min(run_hashes(hashes, k), window - k + 1)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _read(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(ord, tid, n_words, sha, s1, s2, fps) of docs(ord, tid, text binary): s1 and s2 hash all words of a text that has a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, s1, s2, fps = [], [], [], [], []
            for text in batch.column(2):
                words = (text.as_py() or b"").split()
                n.append(len(words))
                joined = b" ".join(words)
                sha.append(hashlib.sha256(joined).hexdigest())
                whole = xxhash.xxh3_128_intdigest(joined)
                s1.append((whole >> 64) - (1 << 63))
                s2.append((whole & MASK) - (1 << 63))
                fps.append(np.unique(window_fingerprints(word_hashes(words), window, k)).view(np.int64) if len(words) >= window else np.zeros(0, np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in fps]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(fps)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), lists], names=["ord", "tid", "n_words", "sha", "s1", "s2", "fps"])

    return docs.mapInArrow(run, "ord long, tid long, n_words long, sha string, s1 long, s2 long, fps array<long>")


def _windows(texts: DataFrame, window: int, k: int) -> DataFrame:
    """(ord, tid, pos, w1, w2) of each window of texts(ord, tid, text, marks) whose fingerprint is among the text's marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()
            for a, b in slices(sizes, 1 << 20):
                found = []
                for i in range(a, b):
                    hashes = word_hashes((batch.column(2)[i].as_py() or b"").split())
                    marks = np.asarray(batch.column(3)[i].values).view(np.uint64)
                    pos = np.flatnonzero(np.isin(window_fingerprints(hashes, window, k), marks))
                    found.append((pos, run_hashes(hashes, window)[pos], run_hashes(hashes, window, 1)[pos]))
                n = [len(x[0]) for x in found]
                ids = [np.repeat(np.asarray(batch.column(c).slice(a, b - a)), n) for c in (0, 1)]
                pos, w1, w2 = (np.concatenate([x[c] for x in found]) for c in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(ids[0]), pa.array(ids[1]), pa.array(pos.astype(np.int32)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64))], names=["ord", "tid", "pos", "w1", "w2"])

    return texts.mapInArrow(run, "ord long, tid long, pos int, w1 long, w2 long")


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """(ord, tid, kept binary, n_removed) of texts(ord, tid, text, starts): without the words of the windows at starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, gone = [], []
            for text, starts in zip(batch.column(2), batch.column(3)):
                words = (text.as_py() or b"").split()
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.asarray(starts.values)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                covered = np.cumsum(edge)[:-1] > 0
                kept.append(b" ".join([w for w, c in zip(words, covered.tolist()) if not c]))
                gone.append(int(covered.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary()), pa.array(gone, pa.int64())], names=["ord", "tid", "kept", "n_removed"])

    return texts.mapInArrow(run, "ord long, tid long, kept binary, n_removed long")


class FingerprintIndex:
    """Sorted immutable runs of (fp, did), did a document's number, each a Parquet table in its own folder.

    A manifest in the index's folder lists the runs; a run is listed once it is whole, so that what a lost or
    repeated job has left is never read. Manifests are numbered and the last one counts; an index is opened
    again by its path, in any session.
    """

    def __init__(self, spark: SparkSession, path: str, fan_in: int = 2):
        self.spark, self.path, self.fan_in = spark, path, fan_in
        held = self._manifests()
        self.version = int(held[-1].rsplit("-", 1)[1]) if held else 0
        self.runs: list[str] = []
        if held:
            with open_shared(f"{path}/{held[-1]}", "rb") as f:
                self.runs = [f"{path}/{name}" for name in json.loads(f.read())]

    def _manifests(self) -> list[str]:
        found = self._files().globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-*")) or []
        return sorted(x.getPath().getName() for x in found if x.getLen() > 0)

    def _files(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, runs: list[str]) -> None:
        """Makes runs the index's runs: a new manifest, written aside and renamed when it is whole."""
        self.version += 1
        name = f"{self.path}/manifest-{self.version:09d}"
        with open_shared(f"{self.path}/_manifest", "wb") as f:
            f.write(json.dumps([r.rsplit("/", 1)[1] for r in runs]).encode())
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        self._files().rename(path(f"{self.path}/_manifest"), path(name))
        self.runs = runs

    def _write(self, postings: DataFrame) -> str:
        name = f"{self.path}/run-{len(self.runs)}-{new_path(self.spark, 'r').rsplit('-', 1)[1]}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        postings.repartitionByRange(parts, "fp", "did").sortWithinPartitions("fp").write.parquet(name)
        return name

    def history(self) -> DataFrame | None:
        return self.spark.read.parquet(*self.runs) if self.runs else None

    def ingest(self, postings: DataFrame) -> DataFrame:
        """Appends a batch of distinct postings(fp, did); returns the fingerprints that it shares with the runs or within itself."""
        run = self._write(postings)
        batch = self.spark.read.parquet(run)
        ends = batch.groupBy("fp").agg(F.min("did").alias("least"), F.max("did").alias("most"))
        shared = ends.where("least < most").select("fp")
        if self.runs:
            old = self.history().select("fp")
            shared = shared.union(ends.select("fp").join(old, "fp", "left_semi")).distinct()
        shared = staged(shared, "shared")
        self._list([*self.runs, run])
        if len(self.runs) >= self.fan_in:
            self.compact()
        return shared

    def compact(self) -> None:
        """Merges all runs into one and deletes them; the new run is listed once it is whole."""
        merged, old = self._write(self.history()), self.runs
        self._list([merged])
        for name in old:
            self._files().delete(self.spark._jvm.org.apache.hadoop.fs.Path(name), True)


def verified(texts: DataFrame, window: int, k: int) -> DataFrame:
    """(ord, tid, starts): windows of texts(ord, tid, text, marks) whose word sequence an earlier ord has as well."""
    windows = _windows(texts, window, k)
    first = windows.groupBy("w1", "w2").agg(F.min("ord").alias("least"), F.max("ord").alias("most")).where("least < most").select("w1", "w2", "least")
    # a join of two scans: Spark can split a passage that very many documents share
    first = staged(first, "windows")
    hit = windows.join(first, ["w1", "w2"]).where("ord > least").select("ord", "tid", "pos")
    return hit.groupBy("ord", "tid").agg(F.collect_set("pos").alias("starts"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, k: int = 10, batches: int = 2, index_path: str | None = None, history: DataFrame | None = None) -> DataFrame:
    """One row per input row: id_col, n_words, n_removed, kept_sha256, and kept (binary, null if it is the text's words as they are or none).

    Removes each word that lies in a window of so many consecutive words whose sequence also starts in a
    document with a smaller id. Words are split at \\x20 and \\x09-\\x0D and compared unchanged; windows are
    judged on the input. Null and empty texts have no words; texts of under window words lose none. Ids are
    integers; a null id is below all others; rows that repeat an id do not remove words from each other. Other
    columns are not read; an empty table gives an empty result. Documents are ingested in batches by id.

    index_path is the folder of an index that goes on: only docs are judged and returned, against each other
    and against history, the documents (with the same columns) that earlier calls have put into that index. Of
    history, only the texts that the index names are looked into.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    picked = lambda d: d.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("ord"), F.xxhash64(text_col).alias("tid"), F.col(text_col).cast("binary").alias("text"))
    rows = picked(docs)
    read = staged(_read(rows, window, k), "read")

    # a document whose words equal those of an earlier one loses them all, and needs no fingerprints
    long = read.where(F.col("n_words") >= window)
    first = staged(long.groupBy("s1", "s2").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("first < last").select("s1", "s2", "first"), "first")
    copies = staged(long.select("ord", "tid", "s1", "s2").join(first, ["s1", "s2"]).where("ord > first").select("ord", "tid").distinct(), "copies")
    # later calls may bring a smaller id, or a larger one that only a copy is below: an index that goes on names copies too
    own = long if index_path else long.join(copies, ["ord", "tid"], "left_anti")

    cuts = sorted(set(own.approxQuantile("ord", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    index = FingerprintIndex(spark, index_path or new_path(spark, "fingerprints"))
    # postings name a document by one number; two that share it would only be verified together
    did = F.xxhash64("ord", "tid").alias("did")
    shared = None
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:]):
        part = own
        if low is not None:
            part = part.where(F.col("ord") > int(low))
        if high is not None:
            part = part.where(F.col("ord") <= int(high))
        found = index.ingest(part.select(F.explode("fps").alias("fp"), did))
        shared = found if shared is None else shared.union(found)
    shared = shared.distinct()
    marks = index.history().join(shared, "fp").groupBy("did").agg(F.collect_set("fp").alias("marks"))
    every = rows if history is None else rows.union(picked(history))
    texts = every.withColumn("did", did).join(marks, "did")
    texts = staged(texts.select("ord", "tid", "text", "marks"), "texts")
    starts = verified(texts, window, k)
    cut = _cut(texts.select("ord", "tid", "text").join(starts, ["ord", "tid"]).select("ord", "tid", "text", "starts"), window)
    cut = staged(cut.dropDuplicates(["ord", "tid"]), "cut")

    done = read.join(cut, ["ord", "tid"], "left").join(copies.withColumn("copy", F.lit(True)), ["ord", "tid"], "left")
    copy = F.coalesce("copy", F.lit(False))
    return done.select(
        F.when(F.col("ord") != -(1 << 63), F.col("ord")).alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(_digest([]))).when(F.col("kept").isNotNull(), F.sha2("kept", 256)).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(~copy, F.col("kept")).alias("kept"),
    )
