"""Dimension tables, record schemas and the views that put the driver's tables into the engine's model."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Every age is taken against an explicit instant; this one is the default of queries.
AS_OF = "2024-01-31 00:00:00"

DOCUMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "title", "text", "source_name", "source_type", "domain", "url", "author", "publication_date", "published_date", "freshness_label", "freshness_window", "source_api", "language")]
    + [T.StructField("freshness_score", T.DoubleType()), T.StructField("word_count", T.IntegerType()), T.StructField("collected_at", T.TimestampType())]
)

# Days until a domain's documents count as stale, and the two volatility encodings.
VOLATILITY_DAYS = {"technology": 180, "healthcare": 365, "history": 3650}
VOLATILITY_SCORE = {"technology": 1.0, "healthcare": 0.5, "history": 0.0}
VOLATILITY_LEVEL = {"high": 3, "medium": 2, "low": 1}
VOLATILITY_NAME = {"technology": "high", "healthcare": "medium", "history": "low"}
UNKNOWN_VOLATILITY = 0.5
MAX_AGE_DAYS = {"technology": 365, "healthcare": 730, "history": 3650}
HALF_LIFE_DAYS = 180.0
DEFAULT_DATE = "2024-03-15T00:00:00+00:00"
DEFAULT_WORDS = 312

# The twelve conditions (id, domain, label, least age, greatest age, source mix, configuration).
CONDITIONS = [
    ("C1", "technology", "<= 1 week", 0, 7, ["academic"], "Academic only"),
    ("C2", "technology", "<= 1 week", 0, 7, ["academic", "news"], "Academic + News"),
    ("C3", "technology", "<= 1 week", 0, 7, ["academic", "news", "technical"], "Acad. + News + Tech"),
    ("C4", "technology", "1 wk - 1 mo", 7, 30, ["academic"], "Academic only"),
    ("C5", "technology", "1 wk - 1 mo", 7, 30, ["academic", "news"], "Academic + News"),
    ("C6", "technology", "1 wk - 1 mo", 7, 30, ["academic", "news", "technical"], "Acad. + News + Tech"),
    ("C7", "healthcare", "1-6 months", 30, 180, ["academic"], "Academic only"),
    ("C8", "healthcare", "1-6 months", 30, 180, ["academic", "news"], "Academic + News"),
    ("C9", "healthcare", "6-12 months", 180, 365, ["academic", "news", "technical"], "Acad. + News + Tech"),
    ("C10", "history", ">= 6 mo (adj.)", 180, None, ["academic"], "Academic only"),
    ("C11", "history", ">= 6 mo (adj.)", 180, None, ["academic", "technical"], "Acad. + Archival"),
    ("C12", "history", ">= 6 mo (adj.)", 180, None, ["academic", "technical"], "Acad. + Arch. + Ref."),
]
#: Source level of a condition: single source, two sources, full diversity, in turn.
SOURCE_LEVELS = ["Single-Source", "Two-Source Mix", "Full Diversity"]


def conditions(spark: SparkSession) -> DataFrame:
    """The condition dimension, with its position and source level; twelve rows."""
    rows = [(i + 1, *c, i % 3 + 1, SOURCE_LEVELS[i % 3]) for i, c in enumerate(CONDITIONS)]
    return spark.createDataFrame(rows, "position int, condition_id string, domain string, freshness_label string, min_age_days int, max_age_days int, source_mix array<string>, source_configuration string, source_level int, source_level_name string")


def lookup(values: dict, key: Column, default=None) -> Column:
    """A value by key from a small fixed table, as a CASE that stays in generated code."""
    found = None
    for k, v in values.items():
        found = F.when(key == k, F.lit(v)) if found is None else found.when(key == k, F.lit(v))
    return found.otherwise(F.lit(default))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as corpus records: seq, id, title, text, source_name, source_type, domain, url, publication_date."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    date = F.date_format(F.date_sub(F.lit(AS_OF).cast("date"), ((n * 17) % 4000).cast("int")), "yyyy-MM-dd")
    kind = F.substring("source", 4, 10).cast("int") % 3
    return d.select(
        n.alias("seq"),
        n.cast("string").alias("id"),
        F.substring("text", 1, 60).alias("title"),
        "text",
        "lang",
        F.col("source").alias("source_name"),
        F.when(kind == 0, "academic").when(kind == 1, "news").otherwise("technical").alias("source_type"),
        F.when(n % 3 == 0, "technology").when(n % 3 == 1, "healthcare").otherwise("history").alias("domain"),
        F.concat(F.lit("https://www.site"), (n % 40).cast("string"), F.lit(".org/docs/"), (n % 700).cast("string"), F.when(n % 5 == 0, "?utm_source=x").otherwise("")).alias("url"),
        F.when(n % 29 == 7, "").when(n % 31 == 9, "n.d.").otherwise(date).alias("publication_date"),
    )


#: The same view in SQL, for a WITH clause.
CORPUS_SQL = """corpus AS (
  SELECT doc_id AS seq, doc_id::VARCHAR AS id, substr(text, 1, 60) AS title, text, lang, source AS source_name,
    CASE substr(source, 4, 10)::INT % 3 WHEN 0 THEN 'academic' WHEN 1 THEN 'news' ELSE 'technical' END AS source_type,
    CASE doc_id % 3 WHEN 0 THEN 'technology' WHEN 1 THEN 'healthcare' ELSE 'history' END AS domain,
    'https://www.site' || (doc_id % 40) || '.org/docs/' || (doc_id % 700) || CASE WHEN doc_id % 5 = 0 THEN '?utm_source=x' ELSE '' END AS url,
    CASE WHEN doc_id % 29 = 7 THEN '' WHEN doc_id % 31 = 9 THEN 'n.d.'
      ELSE strftime(DATE '2024-01-31' - ((doc_id * 17) % 4000)::INT, '%Y-%m-%d') END AS publication_date
  FROM documents)"""
#: Age in days of corpus rows against AS_OF: null where the date does not parse.
AGED_SQL = CORPUS_SQL + """, aged AS (
  SELECT *, CASE WHEN try_cast(publication_date AS DATE) IS NOT NULL
    THEN greatest(0, date_diff('day', try_cast(publication_date AS DATE), DATE '2024-01-31')) END::DOUBLE AS age_days FROM corpus)"""


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question, response, reference): user turns with the assistant turn after, and a benchmark text, by turns of all that there are."""
    c = table(spark, sf_dir, "conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    r = c.where("role = 'assistant'").select(F.col("conv_id").alias("c2"), (F.col("turn") - 1).alias("t2"), F.col("text").alias("response"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id"), F.col("text").alias("reference"))
    size = (b.agg(F.max("item_id")).first()[0] or 0) + 1
    pairs = q.join(r, (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2")))
    return pairs.join(b, F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(size)) == F.col("item_id")).select("conv_id", "turn", "question", "response", "reference")


QA_SQL = """qa AS (
  SELECT q.conv_id, q.turn, q.text AS question, r.text AS response, b.text AS reference
  FROM conversations q JOIN conversations r ON r.conv_id = q.conv_id AND r.turn = q.turn + 1 AND r.role = 'assistant'
  JOIN benchmark b ON b.item_id = (q.conv_id * 7 + q.turn) % (SELECT max(item_id) + 1 FROM benchmark) WHERE q.role = 'user')"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(metric, level, volatility, n, mean, std): events by type and user, as sufficient statistics of three levels by three volatilities."""
    e = table(spark, sf_dir, "events")
    level = (F.col("user_id") % 3 + 1).cast("int")
    vol = F.when(F.col("event_id") % 3 == 0, "low").when(F.col("event_id") % 3 == 1, "medium").otherwise("high")
    return e.groupBy(F.col("event_type").alias("metric"), level.alias("level"), vol.alias("volatility")).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))


CELLS_SQL = """cells AS (
  SELECT event_type AS metric, (user_id % 3 + 1)::INT AS level,
    CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS volatility,
    count(value) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std
  FROM events GROUP BY ALL)"""


# Phrases that give synthetic prose something for the classifiers to find.
TITLES = ["API reference guide", "Just a moment", "Hospital patient care notes", "Museum archive collections", "Breaking news market stock earnings", "Software platform data systems", "History of heritage archives", "Live score football match"]
TAILS = ["documentation developer tutorial example", "captcha security check browser integrity check", "clinical treatment of disease in health care", "archival manuscript history record museum", "nasdaq stock shares earnings crypto bitcoin", "cloud computing software algorithm network", "world cup cricket football innings", "historical archaeology excavation monument"]


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus with titles, text ends and source names that the classifiers tell apart."""
    n = F.col("seq")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))
    return corpus(spark, sf_dir).withColumns({
        "title": pick(TITLES, n),
        "text": F.concat("text", F.lit(" "), pick(TAILS, F.floor(n / 3))),
        "source_name": F.when(n % 10 == 2, "googlesearch").when(n % 10 == 4, "Wikipedia").otherwise(F.col("source_name")),
    })


SIGNALS_SQL = CORPUS_SQL + f""", signals AS (
  SELECT * REPLACE ({TITLES!r}[(seq % 8 + 1)::INT] AS title, text || ' ' || {TAILS!r}[((seq // 3) % 8 + 1)::INT] AS text,
    CASE WHEN seq % 10 = 2 THEN 'googlesearch' WHEN seq % 10 = 4 THEN 'Wikipedia' ELSE source_name END AS source_name) FROM corpus)"""
