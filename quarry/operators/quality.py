"""Record metadata, cleaning, and the quality cascade with its drop reasons."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import dates, terms, text, urls
from quarry.storage import checkpoints, spread

#: Reasons in the order in which they are tested; the first that holds counts.
REASONS = ["dropped_empty_title_or_text", "dropped_interstitial_page", "dropped_short_text", "dropped_domain_relevance", "dropped_non_documentation", "dropped_duplicate_url", "dropped_duplicate_content"]


def least_length(source_type: Column) -> Column:
    return F.when(source_type.isin("academic", "news") | (text.text_or_empty(source_type) == ""), 120).otherwise(200)


def ensure_metadata(docs: DataFrame, as_of: str) -> DataFrame:
    """Fills published_date, freshness_window, source_api, language where empty; word_count is always made anew."""
    has = set(docs.columns)
    old = lambda c: F.col(c) if c in has else F.lit(None).cast("string")
    # the age is a column of its own, as many branches ask for it
    docs = docs.withColumn("__age", dates.age_days(F.col("publication_date"), as_of))
    age = F.col("__age")
    domain = text.filled(F.col("domain"), F.lit("technology"))
    window = F.when(dates.is_valid_window(old("freshness_window"), domain), F.trim(old("freshness_window"))).otherwise(dates.freshness_window(age, domain))
    new = {
        "published_date": text.filled(old("published_date"), dates.published_date(F.col("publication_date"))),
        "freshness_window": window,
        "source_api": text.filled(old("source_api"), urls.source_api(F.col("source_name"), F.col("url"))),
        "word_count": text.word_count(F.col("text")),
        "language": text.filled(old("language"), F.lit("en")),
    }
    return docs.withColumns(new).drop("__age")


def build_docs(rows: DataFrame, as_of: str) -> DataFrame:
    """Records from parsed rows: title and text trimmed, freshness by the domain's decay, metadata filled, a stable key instead of a random one."""
    rows = rows.withColumn("__score", dates.freshness_linear_volatility(dates.age_days(F.col("publication_date"), as_of), F.col("domain")))
    score = F.col("__score")
    key = F.concat_ws("_", "domain", "source_type", F.substring(F.md5(F.concat_ws("\u0001", F.coalesce("url", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("publication_date", F.lit("")))), 1, 12))
    built = rows.withColumns({"id": key, "title": F.trim(text.text_or_empty(F.col("title"))), "text": F.trim(text.text_or_empty(F.col("text"))), "freshness_score": F.round(score, 4), "freshness_label": dates.freshness_label(score)})
    return ensure_metadata(built.drop("__score"), as_of)


def with_freshness(docs: DataFrame, as_of: str) -> DataFrame:
    """freshness_score and freshness_label by the collection's domain."""
    score = dates.freshness_linear_volatility(F.col("__age"), F.col("domain"))
    rows = docs.withColumn("__age", dates.age_days(F.col("publication_date"), as_of)).withColumn("__score", score)
    return rows.withColumns({"freshness_score": F.round("__score", 4), "freshness_label": dates.freshness_label(F.col("__score"))}).drop("__score", "__age")


def add_final_fields(docs: DataFrame, as_of: str) -> DataFrame:
    """Metadata again, and freshness by the collection's domain."""
    return with_freshness(ensure_metadata(docs, as_of), as_of)


def relevant() -> Column:
    """Of counted() rows."""
    return F.when(F.col("source_type") == "news", terms.news_relevant()).otherwise(terms.domain_relevant())


def documents_only() -> Column:
    """Technical records of the technology domain: no encyclopedia, and scraped pages must be documentation."""
    name = F.lower(F.trim(text.text_or_empty(F.col("source_name"))))
    docs = terms.tech_documentation()
    rule = F.when(name == "wikipedia", False).when(name.isin("googlesearch", "bingsearch"), docs).otherwise(True)
    return F.when((F.col("source_type") == "technical") & (F.col("domain") == "technology"), rule).otherwise(True)


def cleaned(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"title": text.clean_text(F.col("title")), "text": text.clean_text(F.col("text"))})


def clean_data(docs: DataFrame, as_of: str, keywords: dict | None = None) -> DataFrame:
    """Rows that pass every filter: no challenge page, long enough, dated, English, relevant, documentation where asked.

    Metadata is filled on what is kept; beside the counts its code would be too long to compile.
    """
    d = terms.counted(cleaned(spread(docs)), keywords)
    english = text.is_english(F.concat_ws(" ", "title", "text"), F.col("lang") if "lang" in docs.columns else None)
    kept = (
        ~terms.is_interstitial()
        & (F.char_length("text") >= least_length(F.col("source_type")))
        & dates.parse_date(F.col("publication_date")).isNotNull()
        & english
        & relevant()
        & documents_only()
    )
    return ensure_metadata(terms.without_counts(passing(d, kept)), as_of)


def passing(rows: DataFrame, rule: Column) -> DataFrame:
    """Rows for which the rule holds, as where() has them, but tested after the rule's columns are made.

    A filter would be pushed below the counts that it asks for, each test would then have its counts worked out
    again, and the code would be too long to compile. Nothing is pushed below a count that is observed.
    """
    return rows.withColumn("__rule", rule).observe(f"tested-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("n")).where("__rule").drop("__rule")


def first_wins(docs: DataFrame, key: Column, order: list[Column], flag: str) -> DataFrame:
    """Adds flag: whether a row is the first of its key. Rows without a key (null or '') are all first.

    The first is found by an aggregate with map-side combining and joined back, so that no key's rows have to
    meet in one task. The columns of order must name a row.
    """
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    keyed = docs.withColumns({"__key": F.nullif(key, F.lit("")), "__place": place})
    first = keyed.where("__key IS NOT NULL").groupBy(F.col("__key").alias("__k")).agg(F.min("__place").alias("__least"))
    both = keyed.join(first, F.col("__key") == F.col("__k"), "left")
    return both.withColumn(flag, F.col("__k").isNull() | (F.col("__place") == F.col("__least"))).drop("__key", "__place", "__k", "__least")


def quality_reasons(docs: DataFrame, keywords: dict | None = None, clean: bool = True, seq: str = "seq") -> DataFrame:
    """(seq, domain, source_type, reason): why the cascade drops a row, null where it stays. seq names a row.

    Address keys are claimed by rows that pass the tests before, in order of seq; content keys by those that
    have also won their address. A row without an address goes straight to its content. Texts are read once:
    what the two dedup passes need of them is kept as digests in the shared folder.
    """
    checkpoints(docs.sparkSession)
    docs = spread(docs)
    d = terms.counted(cleaned(docs) if clean else docs, keywords)
    c = F.col
    test = (
        F.when((text.text_or_empty(c("title")) == "") | (text.text_or_empty(c("text")) == ""), REASONS[0])
        .when(terms.is_interstitial(), REASONS[1])
        .when(F.char_length("text") < least_length(c("source_type")), REASONS[2])
        .when(~relevant(), REASONS[3])
        .when(~documents_only(), REASONS[4])
    )
    content = F.sha2(text.normalize_text(F.concat_ws(" ", "domain", "source_type", "title", F.substring("text", 1, 1200))), 256)
    d = d.select(c(seq), "domain", "source_type", test.alias("reason"), urls.url_key(c("url"), c("source_type")).alias("__link"), content.alias("__content")).checkpoint()
    d = first_wins(d, F.when(c("reason").isNull(), c("__link")), [c(seq)], "__first").withColumn("reason", F.when(c("reason").isNull() & ~c("__first"), REASONS[5]).otherwise(c("reason"))).drop("__first", "__link").checkpoint()
    d = first_wins(d, F.when(c("reason").isNull(), c("__content")), [c(seq)], "__first").withColumn("reason", F.when(c("reason").isNull() & ~c("__first"), REASONS[6]).otherwise(c("reason")))
    return d.drop("__first", "__content")


def quality_filter(docs: DataFrame, keywords: dict | None = None, seq: str = "seq") -> DataFrame:
    """The cleaned rows that no reason drops."""
    kept = quality_reasons(docs, keywords, seq=seq).where("reason IS NULL").select(seq)
    return cleaned(docs).join(kept, seq, "left_semi")


def drop_counts(reasons: DataFrame) -> DataFrame:
    """(reason, n), with the rows that stay as 'kept'."""
    return reasons.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def should_enrich(docs: DataFrame, least: int = 300) -> DataFrame:
    """Short records whose page is worth fetching: with an address, not academic, no doi link."""
    link = F.lower(F.trim(text.text_or_empty(F.col("url"))))
    return docs.where((F.char_length(F.trim(text.text_or_empty(F.col("text")))) < least) & (link != "") & (F.col("source_type") != "academic") & ~link.rlike(r"^https?://doi\.org/"))


def validation_report(docs: DataFrame, as_of: str, least: int) -> DataFrame:
    """(domain, source_type, n, any_missing, empty_text, high, medium, low, shortfall): a record with several fields missing counts once."""
    blank = lambda c: F.trim(text.text_or_empty(F.col(c))) == ""
    missing = blank("id") | blank("title") | blank("text") | blank("url") | blank("domain") | blank("publication_date")
    rows = docs.withColumn("__score", dates.freshness_linear_volatility(dates.age_days(F.col("publication_date"), as_of), F.col("domain")))
    rows = rows.withColumn("__label", dates.freshness_label(F.col("__score")))
    labels = [F.count_if(F.col("__label") == x).alias(x.lower()) for x in ("High", "Medium", "Low")]
    found = rows.groupBy("domain", "source_type").agg(F.count("*").alias("n"), F.count_if(missing).alias("any_missing"), F.count_if(blank("text")).alias("empty_text"), *labels)
    return found.withColumn("shortfall", F.greatest(F.lit(0), F.lit(least) - F.col("n")))
