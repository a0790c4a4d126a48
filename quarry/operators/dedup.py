"""Order-stable removal of duplicates."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text, urls
from quarry.operators.quality import first_wins
from quarry.storage import new_path, shared_file


def by_title_and_start(docs: DataFrame, seq: str = "seq") -> DataFrame:
    """The first row of each normalized title and first 500 characters."""
    key = text.normalize_text(F.concat_ws(" ", text.text_or_empty(F.col("title")), F.substring(text.text_or_empty(F.col("text")), 1, 500)))
    return first_wins(docs, F.concat(F.lit("k"), F.sha2(key, 256)), [F.col(seq)], "__first").where("__first").drop("__first")


def raw_key():
    """'url::' and the address, else the id and the title."""
    link = F.lower(F.trim(text.text_or_empty(F.col("url"))))
    return F.when(link != "", F.concat(F.lit("url::"), link)).otherwise(F.concat_ws("::", F.lit("id"), F.col("id"), F.col("title")))


def merge_checkpoint(old: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """Old rows, then new ones; the first of each raw_key() stays."""
    both = old.withColumn("__part", F.lit(0)).unionByName(new.withColumn("__part", F.lit(1)))
    return first_wins(both, raw_key(), [F.col("__part"), F.col(seq)], "__first").where("__first").drop("__first", "__part")


def domain_docs(docs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; rows without a key all stay."""
    return first_wins(docs, F.col(key), [F.col(o) for o in order], "__first").where("__first").drop("__first")


def news_candidates(docs: DataFrame, relevant, limit: int, seq: str = "seq") -> DataFrame:
    """Relevant candidates, the first of each address (or source and title start), the first max(8, limit) of them."""
    link = urls.canonical_news_url(F.col("url"))
    key = F.when(link != "", link).otherwise(F.concat_ws("::", F.lower(F.col("source_name")), F.lower(F.substring("title", 1, 220))))
    kept = first_wins(docs.where(relevant), key, [F.col(seq)], "__first").where("__first").drop("__first")
    return kept.orderBy(seq).limit(max(8, limit))


def news_by_two_keys(docs: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows with an address that are the first of their address, and of these the first of their title."""
    link = urls.canonical_news_url(F.col("url"))
    one = first_wins(docs.where(link != ""), link, [F.col(seq)], "__first").where("__first").drop("__first")
    return first_wins(one, text.normalize_text(F.col("title")), [F.col(seq)], "__first").where("__first").drop("__first")


def greedy_leader(vectors: DataFrame, threshold: float, seq: str = "seq", vec: str = "vec", block_bytes: int = 16 << 20) -> DataFrame:
    """(seq, kept): in order of seq, a kept row removes later rows at or above the cosine threshold; removed rows remove none.

    Rows lie in blocks of so many bytes by seq, in the shared folder, and are decided block by block: a block is
    compared with the kept rows of all blocks before, each in a task of its own, then within itself. So only kept
    rows are compared and no pair is ever written; the driver holds a name a block and the hits of one. Rows
    without a vector, or with a null in it, are kept; all vectors have one length; seq is a distinct whole number.
    """
    spark = vectors.sparkSession
    folder = new_path(spark, "leaders")
    whole = F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull())
    rows = vectors.select(F.col(seq).cast("long").alias("seq"), F.when(whole, F.transform(vec, lambda x: x.cast("double"))).alias("v"))
    size = rows.where("v IS NOT NULL").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    count = max(1, -(-size["n"] * 8 * (size["d"] or 1) // block_bytes))

    def write(name: str, ids: np.ndarray, x: np.ndarray) -> None:
        held = io.BytesIO()
        np.savez(held, ids=ids, x=x)
        with shared_file(f"{folder}/{name}", "wb") as out:
            out.write(held.getvalue())

    def read(name: str) -> tuple[np.ndarray, np.ndarray]:
        with shared_file(f"{folder}/{name}", "rb") as f:
            found = np.load(io.BytesIO(f.read()))
        return found["ids"], found["x"]

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            ids = np.concatenate([np.asarray(b.column(0)) for b in held])
            x = np.concatenate([np.asarray(b.column(1).flatten()) for b in held]).reshape(len(ids), -1)
            order, name = np.argsort(ids), uuid.uuid4().hex
            write(name, ids[order], (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))[order])
            yield pa.RecordBatch.from_pydict({"first": [int(ids.min())], "name": [name]})

    blocks = rows.where("v IS NOT NULL").repartitionByRange(count, "seq").mapInArrow(save, "first long, name string").collect()
    kept: list[str] = []
    spread = spark.sparkContext.defaultParallelism
    for _, block in sorted(map(tuple, blocks)):

        def hits(frames: Iterator[pd.DataFrame], block: str = block) -> Iterator[pd.DataFrame]:
            x = read(block)[1]
            for frame in frames:
                for name in frame["name"]:
                    y = read(name)[1]
                    hit = np.zeros(len(x), bool)
                    for s in range(0, len(x), 1024):
                        hit[s : s + 1024] = (x[s : s + 1024] @ y.T >= threshold).any(axis=1)
                    yield pd.DataFrame({"at": np.flatnonzero(hit)})

        gone = []
        if kept:
            before = spark.createDataFrame([(k,) for k in kept], "name string").repartition(min(len(kept), spread))
            gone = [r["at"] for r in before.mapInPandas(hits, "at long").distinct().collect()]

        def decide(frames: Iterator[pd.DataFrame], block: str = block, gone: list = gone) -> Iterator[pd.DataFrame]:
            ids, x = read(block)
            for frame in frames:
                alive = np.ones(len(ids), bool)
                alive[gone] = False
                for i in range(len(ids)):
                    if alive[i]:
                        alive[i + 1 :] &= x[i + 1 :] @ x[i] < threshold
                for name in frame["name"]:
                    write(name, ids[alive], x[alive])
                    yield pd.DataFrame({"seq": ids, "kept": alive})

        name = uuid.uuid4().hex
        spark.createDataFrame([(name,)], "name string").coalesce(1).mapInPandas(decide, "seq long, kept boolean").write.mode("append").parquet(f"{folder}/decided")
        kept.append(name)
    none = rows.where("v IS NULL").select("seq", F.lit(True).alias("kept"))
    return spark.read.schema("seq long, kept boolean").parquet(f"{folder}/decided").union(none) if blocks else none
