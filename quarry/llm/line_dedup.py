"""Line dedup with DataFrame functions only.

Lines are exploded, normalised and hashed; documents are counted by hash with map-side partial
aggregates; lines over the threshold go, and each document is put together again by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import ascii_lower

#: White space that is stripped at both ends of a line: \x20 and \x09-\x0D.
STRIP = " \t\n\x0b\x0c\r"
#: Tasks over which a hot key is spread.
SALTS = 16


def _keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, text hash, pos, 128 bits of the key's hash) for each line that is long enough."""
    key = ascii_lower(F.trim(F.col("line"), F.lit(STRIP)))
    return (
        docs.select("id", "fid", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
        .select("id", "fid", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "fid", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop lines whose key occurs in at least min_docs documents, but for the document with the largest id.

    Returns one row per input row: id_col, text (what stays), n_lines, n_dropped.

    A line's key is the line stripped of \\x20 and \\x09-\\x0D with A-Z lower-cased; keys of under min_chars
    code points never drop. Keys are compared by a 128-bit hash. Null and empty texts are one empty line.
    Rows that repeat an id count as one document, and each gets its own result; a null id is one document
    that sorts below all others. Columns other than the two named are not read, whatever their names. An
    empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("fid", F.xxhash64("t"))
    keys = _keys(base, min_chars)
    repeated = not base.groupBy("id").count().where("count > 1").isEmpty()
    once = keys.select("id", "h1", "h2")
    if repeated:
        once = once.distinct()
    else:
        # an id has one row, so its lines can be made distinct before they leave it
        key = lambda x: ascii_lower(F.trim(x, F.lit(STRIP)))
        once = (
            base.select("id", F.explode(F.array_distinct(F.transform(F.split("t", "\n"), key))).alias("key"))
            .where(F.char_length("key") >= min_chars)
            .select("id", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
        )
    over = once.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).select("h1", "h2", "keeper")
    # a line that very many documents hold is spread over SALTS tasks; the dropped keys are few and are repeated for each
    over = over.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    keys = keys.withColumn("salt", F.pmod(F.hash("id", "fid"), F.lit(SALTS)))
    gone = (
        keys.join(over, ["h1", "h2", "salt"])
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "fid")
        .agg(F.collect_set("pos").alias("gone"))
        .select(F.col("id").alias("gid"), F.col("fid").alias("gfid"), "gone")
    )
    lines = base.select("id", "fid", F.split("t", "\n").alias("lines"))
    both = lines.join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("fid") == F.col("gfid")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    text = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda p: F.get(F.col("lines"), p)), "\n"))
    return both.select(
        F.col("id").alias(id_col),
        text.alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )
