"""Queries over connectors' payloads: each payload is written from a table and read back, so that SQL can tell what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import clean_text_sql
from quarry.functions.urls import SKIPPED
from quarry.plans.registry import query
from quarry.sources import feeds
from quarry.schema import table

DAY = "strftime(o_orderdate, '%Y-%m-%d')"


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("q001_arxiv", f"SELECT o_orderkey, 'http://arxiv.org/abs/' || o_orderkey AS id, 'Order ' || o_orderpriority AS title, 'sum of ' || o_custkey AS text, {DAY} AS publication_date, 'http://arxiv.org/abs/' || o_orderkey AS url, 'http://arxiv.org/pdf/' || o_orderkey || '.pdf' AS pdf_url, 'Ann, Bob' AS author FROM orders")
def q001(spark, d):
    entry = F.format_string("<feed><entry><id>http://arxiv.org/abs/%s</id><title> Order\n %s</title><summary>sum of %s</summary><published>%s</published><author><name>Ann</name></author><author><name>Bob</name></author></entry></feed>", F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_custkey"), F.col("day"))
    return feeds.arxiv(_orders(spark, d).withColumn("p", entry), "o_orderkey", "p")


@query("q002_pubmed", """SELECT o_orderkey, o_custkey::VARCHAR AS id, 'T ' || o_orderkey AS title, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE 'one two' END AS text,
  CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-01') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS publication_date,
  'https://pubmed.ncbi.nlm.nih.gov/' || o_custkey || '/' AS url, CASE WHEN o_orderkey % 5 > 0 THEN 'Ann Lee, Bob' END AS author FROM orders""")
def q002(spark, d):
    """Article sets with each of the places in which a date may stand."""
    n, y, mon, day = F.col("o_orderkey"), F.substring("day", 1, 4), F.date_format(F.col("day").cast("date"), "MMM"), F.substring("day", 9, 2)
    number = F.substring("day", 6, 2)
    whole = lambda tag, m: F.format_string(f"<{tag}><Year>%s</Year><Month>%s</Month><Day>%s</Day></{tag}>", y, m, day)
    issue = F.when(n % 6 == 0, whole("PubDate", mon)).when(n % 6 == 2, F.format_string("<PubDate><MedlineDate>%s %s-Dec</MedlineDate></PubDate>", y, mon)).otherwise("<PubDate><Season>Spring</Season></PubDate>")
    electronic = F.when(n % 6 == 1, whole("ArticleDate", number)).otherwise("")
    outer = F.when(n % 6 == 3, whole("DateCompleted", number)).when(n % 6 == 4, whole("DateCreated", number)).otherwise("")
    abstract = F.when(n % 4 == 3, "").otherwise("<Abstract><AbstractText Label='A'>one </AbstractText><AbstractText> </AbstractText><AbstractText>two</AbstractText></Abstract>")
    authors = F.when(n % 5 > 0, "<AuthorList><Author><LastName>Lee</LastName><ForeName>Ann</ForeName></Author><Author><LastName>Bob</LastName></Author><Author><Initials>X</Initials></Author></AuthorList>").otherwise("")
    p = F.concat(
        F.lit("<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version='1'>"), F.col("o_custkey").cast("string"), F.lit("</PMID>"), outer, F.lit("<Article><Journal><JournalIssue>"), issue,
        F.lit("</JournalIssue></Journal><ArticleTitle>T "), n.cast("string"), F.lit("</ArticleTitle>"), abstract, authors, electronic, F.lit("</Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"),
    )
    return feeds.pubmed(_orders(spark, d).withColumn("p", p), "o_orderkey", "p")


@query("q006_rss", f"SELECT o_orderkey, 'T' || k AS title, CASE WHEN k % 2 = 0 THEN 'text more' ELSE 'T' || k END AS text, {DAY} AS publication_date, 'http://n.org/' || k AS url, 'Src' AS source_name FROM orders, (SELECT unnest(range(5)) AS k)")
def q006(spark, d):
    """RSS scans #6 and #7: the least cap of five items."""
    item = lambda k: F.format_string(f"<item><title>T{k}</title><link>http://n.org/{k}</link><description>{'&lt;p&gt;text &amp;amp; more&lt;/p&gt;' if k % 2 == 0 else ''}</description><pubDate>%s</pubDate><source>Src</source></item>", F.col("day"))
    p = F.concat(F.lit("<rss><channel>"), *[item(k) for k in range(7)], F.lit("</channel></rss>"))
    return feeds.rss(_orders(spark, d).withColumn("p", p), "o_orderkey", "p", 3)


@query("q004_wikipedia", f"SELECT o_orderkey, o_custkey::VARCHAR AS id, 'A ' || o_orderkey % 3 AS title, CASE WHEN o_orderkey % 4 < 3 THEN 'body' WHEN o_orderkey % 3 = 1 THEN 'short one' END AS text, CASE WHEN o_orderkey % 2 = 0 THEN {DAY} ELSE '2000-01-01' END AS publication_date, 'https://en.wikipedia.org/wiki/A_' || o_orderkey % 3 AS url FROM orders")
def q004(spark, d):
    """Pages with and without extracts; one of three titles has a summary."""
    n = F.col("o_orderkey")
    p = F.format_string('{"query":{"pages":{"7":{"pageid":%s,"title":"A %s"%s%s}}}}', F.col("o_custkey"), n % 3, F.when(n % 4 < 3, ',"extract":"body"').otherwise(""), F.when(n % 2 == 0, F.format_string(',"timestamp":"%s"', "day")).otherwise(""))
    summaries = spark.createDataFrame([("A 1", "short one")], "title string, summary string")
    return feeds.wikipedia(_orders(spark, d).withColumn("p", p), "o_orderkey", "p", summaries)


@query("q005_gdelt", f"SELECT o_orderkey, 'H' AS title, 'H' AS text, {DAY} AS publication_date, 'http://x/' || o_custkey AS url, 'x' AS source_name, 'large language models health' AS asked FROM orders")
def q005(spark, d):
    p = F.format_string('{"articles":[{"url":"http://x/%s","title":"H","seendate":"%s","domain":"x"}]}', F.col("o_custkey"), F.col("day"))
    return feeds.gdelt(_orders(spark, d).withColumn("p", p), "o_orderkey", "p").withColumn("asked", feeds.gdelt_query(F.lit("a Large language AI models"), F.lit("health")))


@query("q008_crossref", "SELECT o_orderkey, '10.1/' || o_custkey AS id, 'T' AS title, 'x' AS text, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01') ELSE strftime(o_orderdate, '%Y-01-01') END AS publication_date, 'https://doi.org/10.1/' || o_custkey AS url FROM orders")
def q008(spark, d):
    y, m, t = (F.substring("day", a, n).cast("int").cast("string") for a, n in ((1, 4), (6, 2), (9, 2)))
    n = F.col("o_orderkey") % 3
    when = F.when(n == 0, F.format_string('"published-print":{"date-parts":[[%s,%s,%s]]},"created":{"date-parts":[[1900]]}', y, m, t)).when(n == 1, F.format_string('"published-online":{"date-parts":[[%s,%s]]}', y, m)).otherwise(F.format_string('"created":{"date-parts":[[%s]]}', y))
    p = F.format_string('{"message":{"items":[{"DOI":"10.1/%s","title":["T"],"abstract":"<p>x</p>",%s}]}}', F.col("o_custkey"), when)
    return feeds.crossref(_orders(spark, d).withColumn("p", p), "o_orderkey", "p")


@query("q013_child_links", f"""WITH h AS (SELECT page_id, unnest(hs) AS h, unnest(range(len(hs))) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1) AS hs FROM pages)),
l AS (SELECT page_id, regexp_replace(CASE WHEN starts_with(h, '/') THEN 'https://base.org' || h ELSE h END, '#.*$', '') AS link, i FROM h),
o AS (SELECT page_id, link, min(i) AS i FROM l WHERE regexp_matches(link, '^https?://') AND link <> 'https://base.org/the' AND NOT ({' OR '.join(f"contains(lower(link), '{x}')" for x in SKIPPED)}) GROUP BY page_id, link),
k AS (SELECT page_id, list(link ORDER BY i)[:16] AS links FROM o GROUP BY page_id) SELECT p.page_id, coalesce(links, []) AS links FROM pages p LEFT JOIN k USING (page_id)""")
def q013(spark, d):
    """Links of pages (#9, #13), absolute, in order, the first sixteen."""
    return table(spark, d, "pages").select("page_id", feeds.child_links(F.col("html"), F.lit("https://base.org/x"), F.array(F.lit("https://base.org/the")), 16).alias("links"))


META_SQL = lambda n: f"""nullif(regexp_extract(html, '(?i)<meta[^>]*(?:name|property)="{n}"[^>]*content="([^"]*)"', 1), '')"""


@query("q014_article", f"""WITH a AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title, coalesce({', '.join(META_SQL(n) for n in ('article:published_time', 'pubdate', 'date'))}, nullif(regexp_extract(html, '(?i)<time[^>]*datetime="([^"]*)"', 1), ''), '') AS publication_date, {clean_text_sql('html')} AS t FROM pages)
SELECT page_id, title, publication_date, md5(CASE WHEN length(t) >= 120 THEN t ELSE '' END) AS digest FROM a""")
def q014(spark, d):
    return feeds.article(table(spark, d, "pages"), "url", "html").select("page_id", "title", "publication_date", F.md5("text").alias("digest"))


@query("q019_reply_json", "SELECT o_orderkey, o_custkey::INT AS a FROM orders")
def q019(spark, d):
    p = F.format_string('Sure!\n```json\n{"a": %s, "b": {"c": 1}}\n```\nDone.', F.col("o_custkey"))
    return _orders(spark, d).select("o_orderkey", F.from_json(feeds.reply_json(p), "a int")["a"].alias("a"))


@query("q017_human_queries", "SELECT domain || '_h' || lpad((row_number() OVER (PARTITION BY domain ORDER BY o_orderkey))::VARCHAR, 6, '0') AS query_id, domain, CASE WHEN o_orderkey % 5 = 0 THEN 'analytical' ELSE 'factual' END AS query_type, o_orderpriority AS question, o_orderkey % 4 = 0 AS time_sensitive, o_orderkey AS seq FROM (SELECT *, ['technology', 'history'][(o_orderkey % 3 + 1)::INT] AS domain FROM orders WHERE o_orderkey % 3 < 2) WHERE o_custkey % 7 <> 0")
def q017(spark, d):
    n = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        n.alias("seq"),
        F.when(n % 3 == 0, " Technology").when(n % 3 == 1, "history").otherwise("sports").alias("domain"),
        F.when(n % 5 == 0, "Analytical").otherwise("odd").alias("query_type"),
        F.concat(F.lit(" "), "o_orderpriority").alias("question"),
        F.when(F.col("o_custkey") % 7 == 0, "").otherwise("answer").alias("reference_answer"),
        F.when(n % 4 == 0, "Yes").otherwise("no").alias("time_sensitive"),
    )
    return feeds.human_queries(rows, ["technology", "healthcare", "history"])
