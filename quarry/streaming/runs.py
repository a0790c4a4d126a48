"""A run over many queries as an append log: batches of records, each committed once, that a run goes on from after any failure."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import vectors
from quarry.operators.experiment import mean_freshness
from quarry.operators.retrieval import pending, six
from quarry.storage import child_names, commit_file, read_small, remove


class RunLog:
    """Records by query under path: data/<batch>/ holds a batch, commits/<number> says that it counts.

    A batch is data first and a commit after, so one whose run dies in between counts for nothing and its queries
    are still pending. Commits are numbered; two runs that commit at once can't both get a number, and the later
    one finds that the earlier has changed what is pending and makes its batch again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "query_id"):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def batches(self) -> list[str]:
        return [read_small(self.spark, f"{self.path}/commits/{n}")[0] for n in child_names(self.spark, f"{self.path}/commits")]

    def records(self) -> DataFrame:
        """All committed records."""
        paths = [f"{self.path}/data/{b}" for b in self.batches()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def append(self, queries: DataFrame, work: Callable[[DataFrame], DataFrame]) -> bool:
        """Runs work on those of queries that are pending and commits its records; False if another run has committed meanwhile."""
        number = len(child_names(self.spark, f"{self.path}/commits"))
        batch = uuid.uuid4().hex
        done = work(pending(queries, self.records(), self.key))
        self.write(done, batch)
        return self.commit(number, batch)

    def write(self, records: DataFrame, batch: str) -> None:
        names = self.spark.createDataFrame([], self.schema).columns
        records.select(*names).write.parquet(f"{self.path}/data/{batch}")

    def commit(self, number: int, batch: str) -> bool:
        try:
            commit_file(self.spark, f"{self.path}/commits/{number:012d}", [batch])
        except Exception as e:
            if f"{number:012d}" in child_names(self.spark, f"{self.path}/commits"):
                return False
            raise e
        return True

    def run(self, queries: DataFrame, work: Callable[[DataFrame], DataFrame], batch_rows: int = 1000, once: bool = False) -> int:
        """Works on all pending queries in batches of about batch_rows, dealt by hash of the key; returns how many were pending.

        work may leave queries out, as after an error of a back-end; they are pending in the next run. Queries
        without a key are left out, and one that repeats is work's to decide on, within one batch.
        once asks work for all pending queries at a time, as where it is a pass over other tables whatever the batch;
        its records wait by batch and are committed batch by batch, so that the passes don't grow in number with the queries.
        """
        asked = queries.where(F.col(self.key).isNotNull())
        if once:
            return self._run_once(asked, work, batch_rows)
        left = pending(asked, self.records(), self.key).count()
        parts = -(-left // batch_rows)
        for p in range(parts):
            part = asked.where(F.pmod(F.xxhash64(self.key), F.lit(parts)) == p)
            while not self.append(part, work):
                pass
        return left

    def _run_once(self, asked: DataFrame, work: Callable[[DataFrame], DataFrame], batch_rows: int) -> int:
        spark, base = self.spark, f"{self.path}/waiting/{uuid.uuid4().hex}"
        seen = len(child_names(spark, f"{self.path}/commits"))
        pending(asked, self.records(), self.key).write.parquet(f"{base}/asked")
        todo = spark.read.schema(asked.schema).parquet(f"{base}/asked")
        left = todo.count()
        parts = -(-left // batch_rows)
        if parts:
            none = spark.createDataFrame([], self.schema)
            rows = work(todo).select(*none.columns).withColumn("__part", F.pmod(F.xxhash64(self.key), F.lit(parts)))
            rows.repartition("__part").write.partitionBy("__part").parquet(f"{base}/made")
            made = spark.read.schema(none.withColumn("__part", F.lit(0).cast("long")).schema).parquet(f"{base}/made")
        others: list[str] = []
        for p in range(parts):
            while True:
                names = child_names(spark, f"{self.path}/commits")
                # what other runs have committed since this one began; its own batches share no query
                others += [f"{self.path}/data/{read_small(spark, f'{self.path}/commits/{n}')[0]}" for n in names[seen:]]
                seen, batch = len(names), uuid.uuid4().hex
                part = made.where(F.col("__part") == p).drop("__part")
                self.write(pending(part, spark.read.schema(self.schema).parquet(*others), self.key) if others else part, batch)
                if self.commit(seen, batch):
                    seen += 1
                    break
        remove(spark, base)
        return left

    def vacuum(self) -> list[str]:
        """Removes the data of batches that were never committed; no other run may be under way."""
        lost = sorted(set(child_names(self.spark, f"{self.path}/data")) - set(self.batches()))
        for b in lost:
            remove(self.spark, f"{self.path}/data/{b}")
        remove(self.spark, f"{self.path}/waiting")
        return lost


#: What a record holds.
RECORD = (
    "query_id long, question string, query_type string, time_sensitive boolean, domain string, volatility string, freshness_window string, source_config string, condition_id string, reference_answer string, "
    "retrieved_docs array<struct<id: string, title: string, source_name: string, publication_date: string>>, similarities array<double>, relevance_labels array<int>, source_diversity double, avg_freshness double, "
    "retrieval_ms double, response string, latency_ms double, generation_error string, total_ms double"
)


def assemble(queries: DataFrame, hits: DataFrame, docs: DataFrame, replies: DataFrame, relevant: Column) -> DataFrame:
    """Records of queries that have a reply: a query's own columns, its documents in order of rank, and what the back-end said.

    queries(query_id, question, query_type, time_sensitive, domain, volatility, freshness_window, source_config,
    condition_id, reference_answer, relevance_keywords), hits(query_id, rank, doc_id, similarity), docs(id, title,
    text, source_name, publication_date, freshness), replies(query_id, response, retrieval_ms, latency_ms,
    generation_error). relevant is taken over a hit with its document and its query's keywords. A query without
    hits has empty lists; one without a reply has no record, and one whose reply is an error has.
    """
    asked = queries.select("query_id", "relevance_keywords")
    found = hits.join(docs, hits["doc_id"].cast("string") == docs["id"]).join(asked, "query_id")
    doc = F.struct("rank", F.struct("id", "title", "source_name", "publication_date").alias("doc"), "similarity", relevant.cast("int").alias("label"))
    lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list(doc)).alias("x"), six(mean_freshness(F.col("freshness"))).alias("avg_freshness"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    both = queries.drop("relevance_keywords").join(lists, "query_id", "left").join(replies, "query_id")
    took = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return both.select(
        *[c for c in queries.columns if c != "relevance_keywords"],
        none(F.col("x.doc"), "array<struct<id: string, title: string, source_name: string, publication_date: string>>").alias("retrieved_docs"),
        none(F.col("x.similarity"), "array<double>").alias("similarities"), none(F.col("x.label"), "array<int>").alias("relevance_labels"),
        F.coalesce(vectors.entropy(F.col("x.doc.source_name")), F.lit(0.0)).alias("source_diversity"), F.coalesce("avg_freshness", F.lit(0.0)).alias("avg_freshness"),
        F.round("retrieval_ms", 2).alias("retrieval_ms"), F.coalesce("response", F.lit("")).alias("response"), "latency_ms", "generation_error", F.round(took("retrieval_ms") + took("latency_ms"), 2).alias("total_ms"),
    )
