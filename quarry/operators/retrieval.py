"""Exact top-k retrieval and what is computed on its results."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.storage import new_path, shared_file

#: Queries in a block; scores that are held at a time; rows of a shard at most.
QUERY_ROWS, SCORES, SHARD_ROWS = 2000, 1 << 22, 1 << 18


def best_of(block: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of block, id, similarity) of the k most similar rows of x for each row of block, ties by id; a slice of block at a time, so that SCORES bounds the products."""
    step, most = max(1, SCORES // len(ids)), min(k, len(ids))
    for a in range(0, len(block), step):
        sims = np.round(block[a : a + step] @ x.T, 6)
        # all rows as good as the k-th best, so that ties go by id
        least = np.partition(sims, -most, axis=1)[:, -most]
        q, at = np.nonzero(sims >= least[:, None])
        value = sims[q, at]
        order = np.lexsort((ids[at], -value, q))
        q, at, value = q[order], at[order], value[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < k
        yield q[top] + a, ids[at[top]], value[top]


def top_k(index: DataFrame, queries: DataFrame, k: int, index_id: str, index_vec: str, query_id: str, query_vec: str, measure: str = "cosine", shard_bytes: int = 64 << 20, by: str | None = None) -> DataFrame:
    """(query_id, rank, index_id, similarity): for each query its k most similar rows, ties by id; by, a string column of both, keeps queries to rows of their own part.

    A block nested loop without a shuffle of the index: queries are written to the shared folder in blocks; the
    index is taken where it lies, in shards of so many bytes, each of which reads every block (of its own parts),
    as matrix products of bounded size, and passes on its best k. Rows and queries without an id, without a
    vector, with a null in it, or without a part are left out; all vectors have one length. An empty side gives
    an empty result. With by, its column comes first.
    """
    spark = index.sparkSession
    folder = new_path(spark, "top-k")
    part = F.col(by) if by else F.lit("")
    whole = lambda i, v: F.col(i).isNotNull() & F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull()) & part.isNotNull()
    picked = lambda d, i, v: d.where(whole(i, v)).select(part.alias("part"), F.col(i).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"))

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = table.column("id").to_numpy()
        x = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        return ids, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if measure == "cosine" else x

    def parts(batches: list[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
        table = pa.Table.from_batches(batches)
        names = table.column("part").combine_chunks().dictionary_encode()
        for i, name in enumerate(names.dictionary.to_pylist()):
            yield name, table.filter(pc.equal(names.indices, i)) if len(names.dictionary) > 1 else table

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value, table in parts([batch] if batch.num_rows else []):
                for a in range(0, table.num_rows, QUERY_ROWS):
                    held, name = io.BytesIO(), uuid.uuid4().hex
                    ids, x = matrix(table.slice(a, QUERY_ROWS))
                    np.savez(held, ids=ids, x=x)
                    with shared_file(f"{folder}/{name}", "wb") as out:
                        out.write(held.getvalue())
                    yield pa.RecordBatch.from_pydict({"part": [value], "name": [name]})

    asked = picked(queries, query_id, query_vec)
    # a name for so many queries; a repeated task's extra files are named by no row
    names: dict[str, list[str]] = {}
    for r in (asked.repartition("part") if by else asked).mapInArrow(save, "part string, name string").collect():
        names.setdefault(r["part"], []).append(r["name"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rows = [], 0, 0

        def answer() -> Iterator[pa.RecordBatch]:
            for value, table in parts(held):
                ids, x = matrix(table)
                for name in names.get(value, []):
                    with shared_file(f"{folder}/{name}", "rb") as f:
                        block = np.load(io.BytesIO(f.read()))
                    asked_ids = block["ids"]
                    for q, found, similarity in best_of(block["x"], ids, x, k):
                        yield pa.RecordBatch.from_arrays([pa.array([value] * len(q), pa.string()), pa.array(asked_ids[q]), pa.array(found), pa.array(similarity)], names=["part", "qid", "id", "similarity"])

        for batch in batches:
            for a in range(0, batch.num_rows, SHARD_ROWS):
                held.append(batch.slice(a, SHARD_ROWS))
                size, rows = size + held[-1].nbytes, rows + held[-1].num_rows
                if size >= shard_bytes or rows >= SHARD_ROWS:
                    yield from answer()
                    held, size, rows = [], 0, 0
        if held:
            yield from answer()

    found = picked(index, index_id, index_vec).mapInArrow(run, "part string, qid long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("part", "qid").orderBy(F.desc("similarity"), "id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select(*([F.col("part").alias(by)] if by else []), F.col("qid").alias(query_id), "rank", F.col("id").alias(index_id), "similarity")


def relevance_label(title: Column, body: Column, keywords: Column) -> Column:
    """1 if any lower-case keyword is a part of title and text; 1 for all without keywords."""
    blob = F.lower(F.concat_ws(" ", text.text_or_empty(title), text.text_or_empty(body)))
    return F.when(F.coalesce(F.size(keywords), F.lit(0)) == 0, 1).otherwise(F.exists(keywords, lambda k: F.contains(blob, F.lower(k))).cast("int"))


def alignment(similarity: Column) -> Column:
    return F.when(similarity >= 0.7, "HIGH").when(similarity >= 0.5, "MODERATE").otherwise("LOW")


def six(value: Column) -> Column:
    """Rounded to six places as a decimal number, so that the order of summing does not decide a half."""
    return F.round(value.cast("decimal(38,12)"), 6).cast("double")


def six_sql(x: str) -> str:
    """The same in DuckDB SQL."""
    return f"round(({x})::DECIMAL(38,12), 6)::DOUBLE"


def stats(value: Column, name: str) -> list[Column]:
    """mean, sample deviation (0 for one value) and count, as columns name_mean, name_std, name_n."""
    return [six(F.coalesce(F.avg(value), F.lit(0.0))).alias(f"{name}_mean"), six(F.coalesce(F.stddev_samp(value), F.lit(0.0))).alias(f"{name}_std"), F.count(value).alias(f"{name}_n")]


def pending(queries: DataFrame, done: DataFrame, key: str = "query_id") -> DataFrame:
    """Queries that no output holds yet."""
    return queries.join(done.select(key).distinct(), key, "left_anti")


def verify_outputs(outputs: DataFrame, bank: DataFrame, key: str = "query_id") -> DataFrame:
    """Outputs with found: whether the query bank has their query."""
    known = bank.select(F.col(key).alias("__known")).distinct()
    return outputs.join(known, F.col(key) == F.col("__known"), "left").withColumn("found", F.col("__known").isNotNull()).drop("__known")
