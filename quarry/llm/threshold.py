"""Exact ranked lexical search by Fagin's threshold algorithm over sharded indexes.

Documents are indexed shard by shard, where they lie. A shard has both access paths of the algorithm: for each
term a list of its postings by falling impact (sorted access), and for each document its terms with their
impacts (random access). A query's lists are read in turn, a round of postings of every list at a time; each
document met for the first time is looked up in the forward index and scored in full. What a document not met
yet can reach is the threshold, the sum of the impacts that the lists were last read at. Reading stops when the
threshold falls strictly below the k-th best score, so that equal scores with smaller ids are met too.

Scores are integers and use the statistics of all documents, so the shards' best rows are merged exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._common import arrow_batches, new_path, staged
from quarry.llm.blocks import read_block, save_blocks

#: Text bytes in a shard, about; queries in a file; postings of every list in the first round, doubled up to the last.
SHARD_BYTES, QUERY_ROWS, FIRST_ROUND, LAST_ROUND = 32 << 20, 256, 16, 256


def _term_bytes() -> bytes:
    """Of each byte: lower case for A-Z, itself for other letters, digits and parts of non-ASCII characters, else a space."""
    table = bytearray(b" " * 256)
    for b in range(256):
        if b >= 0x80 or chr(b).isalnum():
            table[b] = ord(chr(b).lower()) if b < 0x80 else b
    return bytes(table)


TERM_BYTES = _term_bytes()


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of non-ASCII characters of a UTF-8 text, A-Z lower-cased."""
    return text.translate(TERM_BYTES).split() if text else []


class ForwardShard:
    """Postings of some documents: lists by falling impact, and a forward index by document."""

    def __init__(self, ids: list, texts: list[bytes | None], documents: int, length: int):
        self.code: dict[bytes, int] = {}
        code, tf, n, words = [], [], [], []
        number = self.code
        for text in texts:
            found = Counter(terms(text))
            n.append(len(found))
            words.append(found.total())
            code.extend([number.setdefault(t, len(number)) for t in found])
            tf.extend(found.values())
        self.ids = np.array(ids, np.int64)
        code, tf = np.array(code, np.int32), np.array(tf, np.int64)
        n = np.array(n, np.int64)
        m = 50 + (50 * np.array(words, np.int64) * documents) // max(1, length)
        #: forward index: the postings of document d are those of first[d] to first[d + 1]
        self.first = np.concatenate(([0], np.cumsum(n)))
        self.forward_code = code
        self.forward_impact = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, n))
        doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        order = np.lexsort((-self.forward_impact, code))
        #: sorted lists: the postings of term t are those of start[t] to start[t + 1]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(number))))).astype(np.int64)
        self.doc, self.impact = doc[order], self.forward_impact[order]
        self.weight = np.zeros(max(1, len(number)), np.int64)
        self.seen = np.zeros(len(n), bool)

    def lookup(self, docs: np.ndarray) -> np.ndarray:
        """Full scores of documents under the weights set, by random access."""
        start, size = self.first[docs], self.first[docs + 1] - self.first[docs]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
        return np.add.reduceat(self.weight[self.forward_code[at]] * self.forward_impact[at], ends - size)

    def search(self, wanted: list[bytes], weights: list[int], k: int) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
        """(ids, scores, accesses) of the k best documents with a score above 0, by falling score, then rising id."""
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        lists = [(self.code[t], w) for t, w in zip(wanted, weights) if w > 0 and t in self.code]
        done = {"postings": sum(int(self.start[c + 1] - self.start[c]) for c, _ in lists), "sorted": 0, "random": 0}
        codes = np.array([c for c, _ in lists], np.int64)
        weight = np.array([w for _, w in lists], np.int64)
        at, stop, met = self.start[codes], self.start[codes + 1], []
        self.weight[codes] = weight
        size = FIRST_ROUND
        while len(codes):
            upto = np.minimum(at + size, stop)
            found = np.concatenate([self.doc[a:b] for a, b in zip(at.tolist(), upto.tolist())])
            done["sorted"] += len(found)
            new = np.unique(found[~self.seen[found]])
            if len(new):
                self.seen[new] = True
                met.append(new)
                total = self.lookup(new)
                done["random"] += len(new)
                good = total > (scores[-1] - 1 if len(scores) == k else 0)
                ids, scores = np.concatenate((ids, self.ids[new[good]])), np.concatenate((scores, total[good]))
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            # a list that is read to its end has nothing left for documents not met yet
            threshold = int((weight * self.impact[upto - 1])[upto < stop].sum())
            if len(scores) == k and threshold < scores[-1]:
                break
            left = upto < stop
            codes, weight, at, stop = codes[left], weight[left], upto[left], stop[left]
            size = min(2 * size, LAST_ROUND)
        self.weight[[c for c, _ in lists]] = 0
        for new in met:
            self.seen[new] = False
        return ids, scores, done


def statistics(rows: DataFrame) -> DataFrame:
    """(term, df) over rows(text), combined within batches before the shuffle; term null: documents with a term in df, all terms in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            documents = words = 0
            for text in batch.column(0):
                every = terms(text.as_py())
                documents, words = documents + bool(every), words + len(every)
                found.update(set(every))
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *found], pa.binary()), pa.array([documents, *found.values()], pa.int64()), pa.array([words] + [0] * len(found), pa.int64())], names=["term", "df", "words"]
            )

    return rows.select("text").mapInArrow(run, "term binary, df long, words long")


def threshold_topk(
    docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text: str = "text", shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """(query_col, rank, id_col, score): for each query its k best documents of those with a score above 0.

    A query's terms count once each. Equal scores rank by rising id. Null and empty texts have no terms: such
    documents count in no statistic and are never found, such queries have no row. Rows whose id is null count in
    the statistics but are neither found nor asked. Repeated documents are hits of their own; queries that repeat
    an id are one query of all their terms. Other columns are not read; empty tables give an empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))

    def asked_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = list(set(terms(text.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array([query] * len(found), pa.int64()), pa.array(found, pa.binary())], names=["query", "term"])

    asked = queries.where(F.col(query_col).isNotNull()).select(F.col(query_col).cast("long").alias("query"), F.col(query_text).cast("binary").alias("text"))
    asked = staged(asked.mapInArrow(asked_terms, "query long, term binary").distinct(), "asked")
    # of other terms no frequency is needed, so they go before the shuffle
    counted = statistics(rows).join(asked.select("term").distinct().withColumn("asked", F.lit(True)), "term", "left").where("asked OR term IS NULL")
    counted = staged(counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")), "frequencies")
    whole = counted.where("term IS NULL").first()
    documents, length = (whole["df"], whole["words"]) if whole else (0, 0)
    weight = F.floor(1000 * F.log(F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = asked.join(counted.where("term IS NOT NULL").select("term", weight.alias("w")), "term").where("w > 0")
    # terms in a fixed order, so that reruns read the lists alike
    weights = weights.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("x")).select("query", F.col("x.term").alias("terms"), F.col("x.w").alias("weights"))
    folder = new_path(spark, "queries")
    files = save_blocks(weights, folder, QUERY_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def answer() -> Iterator[pa.RecordBatch]:
            shard = ForwardShard(ids, texts, documents, length)
            for name in files:
                block = read_block(folder, name)
                query, found = [], []
                for q, wanted, w in zip(block.column("query").to_pylist(), block.column("terms").to_pylist(), block.column("weights").to_pylist()):
                    hit = shard.search(wanted, w, k)
                    query.append(np.full(len(hit[0]), q))
                    found.append(hit)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(query)), pa.array(np.concatenate([x[0] for x in found])), pa.array(np.concatenate([x[1] for x in found]))], names=["query", "id", "score"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                texts.append(text.as_py())
                size += len(texts[-1] or b"")
                if size >= shard_bytes:
                    yield from answer()
                    ids, texts, size = [], [], 0
        if ids:
            yield from answer()

    hits = rows.where("id IS NOT NULL").mapInArrow(run, "query long, id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query_col), "rank", F.col("id").alias(id_col), "score")
