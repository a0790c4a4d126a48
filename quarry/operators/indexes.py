"""Vector indexes by condition: built once, kept with a manifest, and built again only where their input has changed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import vectors
from quarry.operators.retrieval import top_k
from quarry.storage import child_names, commit_file, read_small

PART = "condition_id"
#: A manifest row: the digest tells the input, build the folder that holds the condition's rows.
MANIFEST = f"{PART} string, digest string, rows long, dim int, build string"


def inputs(docs: DataFrame, doc_id: str, vec: str) -> DataFrame:
    """(condition_id, digest, rows, dim, error), one aggregate: the digest does not hang on the order of rows; error tells why a condition can't be indexed.

    A condition fails if a row has no id or no vector, a component is null or not finite, or lengths differ.
    """
    h = F.xxhash64(F.col(doc_id), F.col(vec)).cast("decimal(38,0)")
    bad = F.col(doc_id).isNull() | F.col(vec).isNull() | F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = docs.where(F.col(PART).isNotNull()).groupBy(PART).agg(
        # hashes of equal rows would cancel out in a sum of exclusive-ors, so both are taken
        F.md5(F.concat_ws(",", F.sum(h).cast("string"), F.bit_xor(F.xxhash64(F.col(doc_id), F.col(vec))).cast("string"), F.count("*").cast("string"))).alias("digest"),
        F.count("*").alias("rows"), F.max(F.size(vec)).alias("dim"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"), (F.min(F.size(vec)) != F.max(F.size(vec))).alias("uneven"),
    )
    error = F.when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(" rows without an id or a whole vector"))).when(F.col("uneven"), "vectors of different lengths")
    return found.select(PART, "digest", "rows", "dim", error.alias("error"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The newest manifest; without one, an empty table."""
    names = child_names(spark, f"{path}/manifest")
    return spark.createDataFrame([tuple(r) for r in read_small(spark, f"{path}/manifest/{max(names)}")] if names else [], MANIFEST)


def build_indexes(docs: DataFrame, path: str, doc_id: str = "doc_id", vec: str = "embedding", force: bool = False) -> DataFrame:
    """Brings the indexes under path up to date; returns (condition_id, status, rows, dim, error), a row a condition.

    status is built, kept (the input is the one that was indexed), failed (reported, and what was indexed before
    stays), or gone (no row any more; the index is dropped from the manifest). Vectors are stored at unit length,
    a folder a condition, and all that are built take one job. The manifest comes last, as one file: a job that
    dies before leaves the former state, and folders that no manifest names are not read. Rows without a
    condition are left out. There are as many manifest rows as conditions, so they pass through the driver.
    """
    spark = docs.sparkSession
    now = {r[PART]: r for r in inputs(docs, doc_id, vec).collect()}
    old = {r[PART]: r for r in manifest(spark, path).collect()}
    kept = {c for c, r in now.items() if r["error"] is None and not force and c in old and old[c]["digest"] == r["digest"]}
    failed = {c for c, r in now.items() if r["error"] is not None}
    built = sorted(set(now) - kept - failed)
    build = uuid.uuid4().hex
    if built:
        rows = docs.where(F.col(PART).isin(built)).select(PART, F.col(doc_id).alias("doc_id"), vectors.normalize(F.col(vec)).alias("unit"))
        # rows of a condition lie in few files, a large condition in many
        rows.repartition(PART, F.pmod(F.xxhash64("doc_id"), F.lit(8))).write.partitionBy(PART).parquet(f"{path}/data/build={build}")
    rows = [(c, now[c]["digest"], now[c]["rows"], now[c]["dim"], build) for c in built] + [tuple(old[c]) for c in sorted((kept | failed) & set(old))]
    if built or set(old) - set(now):
        names = child_names(spark, f"{path}/manifest")
        commit_file(spark, f"{path}/manifest/{(int(max(names)) + 1 if names else 0):012d}", rows)
    status = [(c, "built" if c in built else "kept" if c in kept else "failed", r["rows"], r["dim"], r["error"]) for c, r in now.items()]
    status += [(c, "gone", 0, None, None) for c in set(old) - set(now)]
    return spark.createDataFrame(sorted(status), f"{PART} string, status string, rows long, dim int, error string")


def read_indexes(spark: SparkSession, path: str, conditions: list[str] | None = None) -> DataFrame:
    """(condition_id, doc_id, unit) of the indexed conditions, or of some: only their folders are listed and read."""
    rows = [r for r in manifest(spark, path).collect() if conditions is None or r[PART] in conditions]
    if not rows:
        return spark.createDataFrame([], f"{PART} string, doc_id long, unit array<double>")
    # a folder's name is the condition's, as Spark escapes it
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    folders = [f"{path}/data/build={r['build']}/{PART}={escape(r[PART])}" for r in rows]
    schema = spark.read.parquet(folders[0]).schema
    return spark.read.option("basePath", f"{path}/data").schema(schema.add("build", "string").add(PART, "string")).parquet(*folders).select(PART, "doc_id", "unit")


def top_k_by_condition(spark: SparkSession, path: str, queries: DataFrame, k: int, query_id: str = "query_id", query_vec: str = "q", conditions: list[str] | None = None) -> DataFrame:
    """(condition_id, query_id, rank, doc_id, similarity): each query's k best rows of the index of its own condition; other conditions' folders are not read."""
    return top_k(read_indexes(spark, path, conditions), queries, k, "doc_id", "unit", query_id, query_vec, by=PART)
