"""The training-data pipeline over documents: language ID, exact dedup, near-dedup, mixing, tokens.

Each stage takes what the one before it kept, writes nothing but what its operator stages in the shared
folder, and returns the columns of documents; only the last returns counts and digests of tokens. What a dedup
stage stages is removed when it has found the rows to drop, and run() removes each stage's input once it is used.

All stages take nulls in any column, empty and very long texts (never cut), rows that repeat, and empty tables.
A stage carries each row as one value beside the few columns that its operator reads, so that no column of the
input, whatever its name, meets a helper column. Ids may be of any type that has an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import bpe, exact_dedup, langid, mixing
from quarry.llm import near as near_copies
from quarry.llm._common import new_path, scratch, staged, table
from quarry.storage import remove

#: Buckets of the filter that picks the rows that may have to go; 32,768 to a bitmap.
DROP_BITS = 1 << 23


def _rows(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text, source, lang) of docs, doc being the whole row."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text", "source", "lang")


def _numbered(docs: DataFrame) -> DataFrame:
    """_rows() and row, a number of its own: the id where ids are whole numbers that are there and don't repeat, else a new one, for which the rows are staged."""
    rows = _rows(docs)
    whole = isinstance(docs.schema["doc_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if whole and docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty():
        return rows.withColumn("row", F.col("doc_id").cast("long"))
    return staged(rows.withColumn("row", F.monotonically_increasing_id()), "stage")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The doc of the rows(row, doc) that gone(row) does not name.

    A filter of fixed size tells most rows that stay where they are read; only the others are moved to be joined.
    """
    # bitmaps count numbers from one
    bit = F.pmod(F.xxhash64("row"), F.lit(DROP_BITS)) + 1
    number, at = F.bitmap_bucket_number(bit), F.bitmap_bit_position(bit)
    maps = gone.select(number.alias("number"), at.alias("at")).groupBy("number").agg(F.bitmap_construct_agg("at").alias("bits"))
    byte = "cast(conv(hex(substring(bits, cast(at div 8 as int) + 1, 1)), 16, 10) as int)"
    marked = rows.select("row", "doc", number.alias("number"), at.alias("at")).join(F.broadcast(maps), "number", "left")
    marked = marked.select("row", "doc", F.expr(f"coalesce(shiftright({byte}, cast(at % 8 as int)) & 1 = 1, false)").alias("open"))
    return marked.where("NOT open").select("doc.*").union(marked.where("open").join(gone, "row", "left_anti").select("doc.*"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no language model accepts: null, empty, without letters, or beyond the calibrated cross-entropy.

    Rows that repeat are accepted or dropped alike. With no labelled document nothing is accepted.
    """
    model = langid.train(docs)
    done = langid.identify(_rows(docs), model, keep=("doc",))
    return done.where(~F.col("rejected")).select("doc.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty), one row stays: that with the largest doc_id, null below all others; of rows that repeat the id as well, any one."""
    rows = _numbered(docs)
    # the row number stands in for the id among rows that repeat one
    place = new_path(spark, "exact-gone")
    with scratch(spark):
        done = exact_dedup.exact_dedup(rows.select(F.struct("doc_id", "row").alias("id"), "text"), id_col="id")
        gone = staged(done.where("NOT kept").select("id.row"), "gone", place)
    return _without(rows, gone)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity 0.8 or more), the document with the smallest doc_id stays, null after all others.

    Texts of under five words are one shingle; null, empty and blank texts are copies of each other.
    """
    rows = _numbered(docs)
    place = new_path(spark, "near-gone")
    with scratch(spark):
        groups = near_copies.near_duplicate_groups(rows, row_col="row", width=5, similarity=0.8)
        groups = staged(groups.join(rows.select("row", "doc_id"), "row"), "groups")
        first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.count("*").alias("n"))
        # cut before the join, so that it may be split where one group is very large
        first = staged(first.where("n > 1").select("group", F.col("first.row").alias("stays")), "first")
        gone = staged(groups.join(first, "group").where("row <> stays").select("row"), "gone", place)
    return _without(rows, gone)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as the mix of its source takes it, three times at most; repeats are rows of their own. A null source is a source."""
    rows = _numbered(docs)
    done = mixing.mix(rows.select("row", "text", "source"), id_col="row").where("copies > 0").select("row", "copies")
    both = rows.select("row", "doc").join(done, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return both.select("doc.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every emitted document; null and empty texts have no token."""
    from public_tokenizers import path

    return bpe.bpe_digests(docs, path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mix_sources", mix_sources),
    ("bpe_tokens", tokenize),
]

#: Language models, XXH64 and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        place = new_path(spark, name)
        with scratch(spark):
            docs = staged(stage(spark, docs, sf_dir), name, place)
        if before is not None:
            remove(spark, before)
        before = place
    return STAGES[-1][1](spark, docs, sf_dir)
