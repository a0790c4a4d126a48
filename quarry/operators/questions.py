"""Documents dealt to questions: what a back-end is asked to write questions about, without a document twice before all have had a turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import excerpt, text_or_empty
from quarry.operators.order import positions

# The kinds of questions in order, the share of the first two, and how much of a document a prompt holds.
KINDS = ["factual", "analytical", "comparative"]
SHARES = {"factual": 0.40, "analytical": 0.35}
EXCERPT = {"factual": 1000, "analytical": 700, "comparative": 700}


def quotas(n: int) -> dict[str, int]:
    """How many of n questions are of each kind; the last kind has what is left."""
    first = {k: int(n * s) for k, s in SHARES.items()}
    return first | {KINDS[2]: n - sum(first.values())}


def slots(domains: DataFrame, n: int) -> DataFrame:
    """(domain, number, query_type, side, place): which place of the shuffled documents each question's documents have; factual ones have one, others two."""
    many = quotas(n)
    f, a = many[KINDS[0]], many[KINDS[1]]
    i = F.col("number")
    kind = F.when(i < f, KINDS[0]).when(i < f + a, KINDS[1]).otherwise(KINDS[2])
    first = F.when(i < f, i).otherwise(f + 2 * (i - f))
    numbered = domains.select("domain", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("number")) if n > 0 else domains.select("domain", F.lit(0).cast("long").alias("number")).where("false")
    each = F.when(i < f, F.array(first)).otherwise(F.array(first, first + 1))
    return numbered.select("domain", "number", kind.alias("query_type"), F.posexplode(each).alias("side", "place"))


def question_documents(docs: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """(domain, query_id, query_type, source_doc_ids, source_urls, title1, source_name1, source_type1, date1, text1, title2, source_name2, date2, text2), n questions a domain.

    docs(domain, id, title, text, source_name, source_type, url, publication_date) of a domain are shuffled by a
    hash of seed and id, and dealt in turn: factual questions first, then those over two documents. Every document
    has its turn before one comes again. Ids must name a row within a domain. Domains with fewer than two documents
    have no questions. Texts are cut to what the prompt of their kind holds. Shuffling is a range sort with offsets,
    so no domain meets in one task, and only the documents that are dealt keep their texts.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    light = docs.where(F.col(id_col).isNotNull() & F.col("domain").isNotNull()).select("domain", F.col(id_col).alias("__id"), key.alias("__key"))
    placed = positions(light, ["domain"], ["__key", "__id"], "__place").where(F.col("__place_of") > 1)
    asked = slots(placed.select("domain", "__place_of").distinct(), n)
    of = placed.groupBy("domain").agg(F.max("__place_of").alias("__many"))
    dealt = asked.join(of, "domain").withColumn("__turn", F.col("place") % F.col("__many")).join(placed.select(F.col("domain").alias("__d"), "__id", "__place"), (F.col("domain") == F.col("__d")) & (F.col("__turn") == F.col("__place")))
    dealt = dealt.select("domain", "number", "query_type", "side", "__id")
    told = docs.select(F.col("domain").alias("__d"), F.col(id_col).alias("__i"), *[text_or_empty(F.col(c)).alias(c) for c in ("title", "source_name", "source_type", "url", "publication_date", "text")])
    both = dealt.join(told, (F.col("domain") == F.col("__d")) & (F.col("__id") == F.col("__i")))
    length = F.when(F.col("query_type") == KINDS[0], EXCERPT[KINDS[0]]).otherwise(EXCERPT[KINDS[1]])
    doc = F.struct("side", F.col("__id").cast("string").alias("id"), "url", "title", "source_name", "source_type", "publication_date", excerpt(F.col("text"), length).alias("text"))
    lists = both.groupBy("domain", "number", "query_type").agg(F.sort_array(F.collect_list(doc)).alias("x"))
    at = lambda i, c: F.get("x", F.lit(i))[c]
    return lists.select(
        "domain", F.concat_ws("_", "domain", "query_type", F.lpad((F.col("number") + 1).cast("string"), 4, "0")).alias("query_id"), "query_type", F.col("x.id").alias("source_doc_ids"), F.col("x.url").alias("source_urls"),
        at(0, "title").alias("title1"), at(0, "source_name").alias("source_name1"), at(0, "source_type").alias("source_type1"), at(0, "publication_date").alias("date1"), at(0, "text").alias("text1"),
        at(1, "title").alias("title2"), at(1, "source_name").alias("source_name2"), at(1, "publication_date").alias("date2"), at(1, "text").alias("text2"),
    )
