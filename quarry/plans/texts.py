"""Queries over text, date and address functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import dates, text, urls
from quarry.plans.registry import query
from quarry.schema import AGED_SQL, AS_OF, CORPUS_SQL, MAX_AGE_DAYS, QA_SQL, VOLATILITY_DAYS, corpus, qa, table
from quarry.operators import quality

NORM = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
CASE_DAYS = "CASE domain " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in VOLATILITY_DAYS.items()) + " END"
CASE_MAX = "CASE domain " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MAX_AGE_DAYS.items()) + " END"


def window_sql(age: str = "age_days", domain: str = "domain") -> str:
    def of(rows):
        return "CASE " + " ".join(f"WHEN {age} <= {m} THEN '{w}'" for m, w in rows[:-1]) + f" ELSE '{rows[-1][1]}' END"

    return f"CASE {domain} WHEN 'healthcare' THEN {of(dates.WINDOWS['healthcare'])} WHEN 'history' THEN {of(dates.WINDOWS['history'])} ELSE {of(dates.WINDOWS['technology'])} END"


@query("q027_clean_text", f"SELECT page_id, {text.clean_text_sql('html')} AS cleaned FROM pages")
def q027(spark, d):
    return table(spark, d, "pages").select("page_id", text.clean_text(F.col("html")).alias("cleaned"))


@query("q028_normalize_text", f"SELECT doc_id, md5({NORM.format('text')}) AS digest FROM documents")
def q028(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("digest"))


FORMATS = ["%Y-%m-%d", "%Y-%m-%dT%H:%M:%SZ", "%a, %d %b %Y %H:%M:%S GMT", "%Y/%m/%d", "%Y%m%dT%H%M%SZ", "%d %b %Y", "%b %d, %Y", "%Y-%m-%d %H:%M:%S", "%a, %d %b %Y %H:%M:%S EST"]


@query("q029_parse_date", """SELECT event_id, date_trunc('second', ts) AS given,
  CASE WHEN event_id % 9 IN (0, 3, 5, 6) THEN date_trunc('day', ts) WHEN event_id % 9 = 8 THEN date_trunc('second', ts) + INTERVAL 5 HOUR
    ELSE date_trunc('second', ts) END::TIMESTAMP AS parsed FROM events""")
def q029(spark, d):
    """Event times written in nine formats, and read back."""
    e = table(spark, d, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("given"))
    java = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss'Z'", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "yyyy/MM/dd", "yyyyMMdd'T'HHmmss'Z'", "dd MMM yyyy", "MMM dd, yyyy", "yyyy-MM-dd HH:mm:ss", "EEE, dd MMM yyyy HH:mm:ss 'EST'"]
    written = F.lit(None).cast("string")
    for i, f in enumerate(java):
        written = F.when(F.col("event_id") % 9 == i, F.date_format("given", f)).otherwise(written)
    return e.select("event_id", "given", dates.parse_date(written).alias("parsed"))


@query("q030_english", """SELECT doc_id, length(trim(text)) >= 60 AND
  len(regexp_extract_all(substr(trim(text), 1, 2500), '[A-Za-z]')) / greatest(length(substr(trim(text), 1, 2500)), 1) > 0.55 AS by_letters,
  length(trim(text)) >= 60 AND lang = 'en' AS by_language FROM documents""")
def q030(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.is_english(t).alias("by_letters"), text.is_english(t, F.col("lang")).alias("by_language"))


@query("q031_freshness_three", f"""WITH {AGED_SQL}
SELECT id, round(CASE WHEN age_days IS NULL THEN 0 ELSE greatest(0, least(1, 1 - age_days / {CASE_DAYS})) END, 4) AS linear_volatility,
  CASE WHEN CASE WHEN age_days IS NULL THEN 0 ELSE greatest(0, least(1, 1 - age_days / {CASE_DAYS})) END >= 0.66 THEN 'High'
    WHEN CASE WHEN age_days IS NULL THEN 0 ELSE greatest(0, least(1, 1 - age_days / {CASE_DAYS})) END >= 0.33 THEN 'Medium' ELSE 'Low' END AS label,
  CASE WHEN age_days IS NULL THEN 0 ELSE round(greatest(0, least(1, 1 - floor(age_days) / {CASE_MAX})), 6) END AS linear_maxage,
  round(exp(-ln(2) * age_days / 180.0), 4) AS half_life FROM aged""")
def q031(spark, d):
    age, dom = F.col("age"), F.col("domain")
    s = dates.freshness_linear_volatility(age, dom)
    return corpus(spark, d).withColumn("age", dates.age_days(F.col("publication_date"))).select("id", F.round(s, 4).alias("linear_volatility"), dates.freshness_label(s).alias("label"), dates.freshness_linear_maxage(age, dom).alias("linear_maxage"), F.round(dates.freshness_half_life(age), 4).alias("half_life"))


#: The domain after a record's own, for which its window need not be valid.
NEXT_DOMAIN = "CASE domain WHEN 'technology' THEN 'healthcare' WHEN 'healthcare' THEN 'history' ELSE 'technology' END"
VALID_SQL = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {{1}} IN ({', '.join(repr(w) for _, w in rows)})" for k, rows in dates.WINDOWS.items()) + " END"


@query("q032_freshness_window", f"WITH {AGED_SQL}, w AS (SELECT id, domain, {NEXT_DOMAIN} AS other, {window_sql()} AS win FROM aged) SELECT id, win, {VALID_SQL.format('domain', 'win')} AS valid, {VALID_SQL.format('other', 'win')} AS valid_next FROM w")
def q032(spark, d):
    """Windows #32 and their validity #33, for a record's own domain and for another one."""
    aged = corpus(spark, d).withColumn("age", dates.age_days(F.col("publication_date")))
    rows = aged.withColumn("win", dates.freshness_window(F.col("age"), F.col("domain")))
    return rows.select("id", "win", dates.is_valid_window(F.col("win"), F.col("domain")).alias("valid"), dates.is_valid_window(F.col("win"), F.expr(NEXT_DOMAIN)).alias("valid_next"))


@query("q034_published_date", f"""WITH {AGED_SQL} SELECT id, CASE WHEN age_days IS NOT NULL THEN publication_date || 'T00:00:00+00:00'
  WHEN publication_date <> '' THEN publication_date ELSE '2024-03-15T00:00:00+00:00' END AS published FROM aged""")
def q034(spark, d):
    return corpus(spark, d).select("id", dates.published_date(F.col("publication_date")).alias("published"))


SOURCE_NAMES = ["arXiv", "PubMed Central", "GDELT", "Google News", "Bing News", "Wikipedia", "Crossref", "GoogleSearch", "BingSearch", "other"]
SOURCE_ANSWERS = ["arxiv", "pubmed", "gdelt", "google_news_rss", "bing_news_rss", "wikipedia", "crossref", "google_search", "bing_search", "unknown"]


@query("q035_source_api", f"SELECT page_id, {SOURCE_ANSWERS!r}[(page_id % 10 + 1)::INT] AS api, CASE WHEN page_id % 2 = 0 THEN 'doi' ELSE 'wikipedia' END AS by_url FROM pages")
def q035(spark, d):
    n = F.col("page_id")
    name = F.element_at(F.array(*[F.lit(s) for s in SOURCE_NAMES]), (n % 10 + 1).cast("int"))
    link = F.when(n % 2 == 0, "https://doi.org/10.1/x").otherwise("https://en.wikipedia.org/wiki/X")
    return table(spark, d, "pages").select("page_id", urls.source_api(name, F.lit("")).alias("api"), urls.source_api(F.lit(None).cast("string"), link).alias("by_url"))


@query("q036_word_count", "SELECT doc_id, coalesce(nullif(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')), 0), 312)::INT AS words FROM documents")
def q036(spark, d):
    return table(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@query("q038_metadata", f"""WITH {AGED_SQL} SELECT id, {window_sql()} AS freshness_window,
  CASE seq % 3 WHEN 0 THEN 'own' ELSE {SOURCE_ANSWERS!r}[(seq % 10 + 1)::INT] END AS source_api,
  coalesce(nullif(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')), 0), 312)::INT AS word_count, CASE seq % 2 WHEN 0 THEN lang ELSE 'en' END AS language FROM aged""")
def q038(spark, d):
    """Fields that are there and valid stay, others are filled: windows of another kind, empty sources and languages."""
    n = F.col("seq")
    rows = corpus(spark, d).withColumns({
        "source_name": F.element_at(F.array(*[F.lit(s) for s in SOURCE_NAMES]), (n % 10 + 1).cast("int")),
        "source_api": F.when(n % 3 == 0, "own").otherwise(""),
        "language": F.when(n % 2 == 0, F.col("lang")),
        "freshness_window": F.when(n % 4 == 1, "last week"),
    })
    return quality.ensure_metadata(rows, AS_OF).select("id", "freshness_window", "source_api", "word_count", "language")


@query("q039_build_doc", f"""WITH {AGED_SQL} SELECT domain || '_' || source_type || '_' ||
  substr(md5(url || chr(1) || title || chr(1) || publication_date), 1, 12) AS id, trim(title) AS title, md5(trim(text)) AS digest,
  round(CASE WHEN age_days IS NULL THEN 0 ELSE greatest(0, least(1, 1 - age_days / {CASE_DAYS})) END, 4) AS freshness_score FROM aged""")
def q039(spark, d):
    return quality.build_docs(corpus(spark, d), AS_OF).select("id", "title", F.md5("text").alias("digest"), "freshness_score")


@query("q173_final_fields", f"""WITH {AGED_SQL} SELECT id, round(CASE WHEN age_days IS NULL THEN 0 ELSE greatest(0, least(1, 1 - age_days / {CASE_DAYS})) END, 4) AS freshness_score, {window_sql()} AS freshness_window FROM aged""")
def q173(spark, d):
    return quality.add_final_fields(corpus(spark, d), AS_OF).select("id", "freshness_score", "freshness_window")


@query("q040_canonical_url", f"SELECT page_id, {urls.canonical_news_url_sql('url')} AS key FROM pages")
def q040(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical_news_url(F.col("url")).alias("key"))


@query("q041_url_key", f"WITH {CORPUS_SQL} SELECT id, CASE WHEN source_type = 'news' THEN {urls.canonical_news_url_sql('url')} ELSE lower(trim(url)) END AS key FROM corpus")
def q041(spark, d):
    return corpus(spark, d).select("id", urls.url_key(F.col("url"), F.col("source_type")).alias("key"))


@query("q042_redirect_target", """SELECT page_id, CASE WHEN page_id % 3 = 2 THEN '' ELSE url END AS target, url AS unwrapped FROM pages""")
def q042(spark, d):
    n, u = F.col("page_id"), F.col("url")
    link = F.when(n % 3 == 0, F.concat(F.lit("https://www.bing.com/news/apiclick.aspx?ref=x&url="), F.url_encode(u))).when(n % 3 == 1, F.concat(F.lit("https://news.google.com/r?target="), F.url_encode(u), F.lit("&a=b"))).otherwise(u)
    wrapped = F.concat(F.lit("https://www.google.com/url?q="), F.url_encode(u), F.lit("&sa=U"))
    return table(spark, d, "pages").select("page_id", urls.redirect_target(link).alias("target"), urls.result_link(wrapped).alias("unwrapped"))


@query("q044_host", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages")
def q044(spark, d):
    return table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"))


@query("q045_should_skip", "SELECT page_id, page_id % 4 = 0 OR page_id % 4 = 1 AS skip FROM pages")
def q045(spark, d):
    n = F.col("page_id")
    link = F.when(n % 4 == 0, "").when(n % 4 == 1, F.concat("url", F.lit("/consent"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", urls.should_skip(link).alias("skip"))


@query("q046_search_query", "SELECT DISTINCT source, source || ' news (a b) \"x y\" the' AS built FROM documents")
def q046(spark, d):
    return table(spark, d, "documents").select("source").distinct().select("source", urls.search_query(F.col("source"), F.lit('news (a b) NEWS "x y"'), F.lit("the The (A B)")).alias("built"))


@query("q048_unique_phrases", "SELECT doc_id, [lang, source, 'x'] AS phrases FROM documents")
def q048(spark, d):
    given = F.array("lang", F.concat(F.lit(" "), F.upper("lang")), F.lit(""), "source", F.lit("x"), F.upper("source"))
    return table(spark, d, "documents").select("doc_id", urls.unique_phrases(given).alias("phrases"))


@query("q050_context", f"WITH {CORPUS_SQL} SELECT source_name, source_type, md5(string_agg('[' || rn || '] ' || title || ' (' || source_name || CASE WHEN publication_date <> '' THEN ', ' || publication_date ELSE '' END || ')' || chr(10) || substr(text, 1, 1200), chr(10) || chr(10) ORDER BY seq)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY source_name, source_type ORDER BY seq) AS rn FROM corpus) WHERE rn <= 5 GROUP BY ALL")
def q050(spark, d):
    """Context blocks of the first five records of each source (the five are the feature: a context has five)."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("source_name", "source_type").orderBy("seq"))
    top = corpus(spark, d).withColumn("rn", rn).where("rn <= 5")
    docs = F.sort_array(F.collect_list(F.struct("rn", F.struct("title", F.col("source_name").alias("source"), F.col("publication_date").alias("date"), "text").alias("d"))))
    got = top.groupBy("source_name", "source_type").agg(F.transform(docs, lambda x: x["d"]).alias("docs"))
    return got.select("source_name", "source_type", F.md5(text.build_context(F.col("docs"))).alias("digest"))


@query("q051_prompt", f"WITH {QA_SQL} SELECT conv_id, turn, md5('Context:' || chr(10) || reference || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Answer:') AS digest FROM qa")
def q051(spark, d):
    return qa(spark, d).select("conv_id", "turn", F.md5(F.format_string("Context:\n%s\n\nQuestion: %s\nAnswer:", "reference", "question")).alias("digest"))


@query("q052_embed_input", f"WITH {CORPUS_SQL} SELECT id, md5(trim(CASE WHEN trim(title) <> '' AND body <> '' THEN trim(title) || '. ' || body ELSE trim(title) || body END)) AS digest FROM (SELECT id, title, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')[1:512], ' ') AS body FROM corpus)")
def q052(spark, d):
    return corpus(spark, d).select("id", F.md5(text.embed_input(F.col("title"), F.col("text"))).alias("digest"))


STEM_SQL = "CASE " + " ".join(f"WHEN ends_with(w, '{s}') AND length(w) >= {len(s) + 3} THEN substr(w, 1, length(w) - {len(s)})" for s in text.SUFFIXES) + " ELSE w END"


@query("q053_stem", f"""WITH t AS (SELECT lang, regexp_replace(lower(unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> ''))), '[.,!?;:"'']+$', '') AS w FROM documents)
SELECT lang, {STEM_SQL} AS stem, count(*) AS n FROM t GROUP BY ALL""")
def q053(spark, d):
    w = table(spark, d, "documents").select("lang", F.explode(text.words(F.col("text"))).alias("w"))
    return w.select("lang", text.bare(F.col("w")).alias("b")).groupBy("lang", text.cut(F.col("b")).alias("stem")).agg(F.count("*").alias("n"))


ALL_CLAIMS_SQL = "list_filter(list_transform(string_split(regexp_replace(trim(coalesce({0}, '')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 20 AND NOT regexp_matches(lower(s), '^(" + "|".join(text.META_PREFIXES) + ")'))"
CLAIMS_SQL = ALL_CLAIMS_SQL + "[1:10]"


@query("q054_claims", f"SELECT doc_id, len({CLAIMS_SQL.format('text')})::INT AS n, md5(array_to_string({CLAIMS_SQL.format('text')}, '|')) AS digest FROM documents")
def q054(spark, d):
    c = text.claims(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(c).alias("n"), F.md5(F.array_join(c, "|")).alias("digest"))


@query("q055_retry_after", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id::DOUBLE WHEN 1 THEN greatest(0, date_diff('second', TIMESTAMP '2024-01-15 00:00:00', date_trunc('second', ts)))::DOUBLE ELSE 0 END AS seconds FROM events")
def q055(spark, d):
    n = F.col("event_id")
    stamp = F.date_format(F.date_trunc("second", F.col("ts").cast("timestamp")), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    given = F.when(n % 3 == 0, n.cast("string")).when(n % 3 == 1, stamp).otherwise("soon")
    return table(spark, d, "events").select("event_id", dates.retry_after_seconds(given, "2024-01-15 00:00:00").alias("seconds"))


@query("q056_age_days", f"WITH {AGED_SQL} SELECT id, age_days FROM aged")
def q056(spark, d):
    return corpus(spark, d).select("id", dates.age_days(F.col("publication_date")).alias("age_days"))


@query("q057_date_range", "SELECT o_orderkey, CASE WHEN o_custkey % 400 > 0 THEN strftime(DATE '2024-01-31' - greatest(o_orderkey % 50, o_custkey % 400)::INT, '%Y/%m/%d') END AS lo, CASE WHEN o_custkey % 400 > 0 THEN strftime(DATE '2024-01-31' - least(o_orderkey % 50, o_custkey % 400)::INT, '%Y/%m/%d') END AS hi FROM orders")
def q057(spark, d):
    low, high = dates.query_date_range(F.col("o_orderkey") % 50, F.col("o_custkey") % 400)
    return table(spark, d, "orders").select("o_orderkey", low.alias("lo"), high.alias("hi"))


MONTH = "['01','02','03','04','05','06','07','08','09','10','11','12'][(p_partkey % 12 + 1)::INT]"


@query("q003_pubmed_dates", f"""SELECT p_partkey, {MONTH} AS by_name, {MONTH} AS by_number, CASE WHEN p_partkey % 40 BETWEEN 1 AND 31 THEN lpad((p_partkey % 40)::VARCHAR, 2, '0') ELSE '01' END AS day,
  (1990 + p_partkey % 30) || '-' || {MONTH} || '-01' AS medline FROM part""")
def q003(spark, d):
    n = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(m.title()) for m in dates.MONTHS]), (n % 12 + 1).cast("int"))
    free = F.concat((n % 30 + 1990).cast("string"), F.lit(" "), name, F.lit("-Dec"))
    return table(spark, d, "part").select("p_partkey", dates.month_number(name).alias("by_name"), dates.month_number((n % 12 + 1).cast("string")).alias("by_number"), dates.day_number((n % 40).cast("string")).alias("day"), dates.medline_date(free).alias("medline"))
