"""Queries over condition indexes, run logs, crawls and published artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import dates, urls
from quarry.functions.text import clean_text_sql, excerpt
from quarry.functions.urls import SKIPPED
from quarry.operators import charts, collection, crawl, dashboard, experiment, indexes, pipeline, questions
from quarry.operators.conditions import build_conditions
from quarry.operators.quality import REASONS
from quarry.operators.retrieval import relevance_label, six_sql, top_k
from quarry.plans.corpora import BUILT_SQL, CLEANED_SQL, DOCS_SQL, KEYWORDS, RELEVANT_SQL
from quarry.plans.experiments import HALLUCINATION_SQL, TOP_SQL
from quarry.plans.registry import SQL, query
from quarry.plans.texts import NORM
from quarry.schema import AGED_SQL, AS_OF, CONDITIONS, CORPUS_SQL, VOLATILITY_DAYS, VOLATILITY_NAME, cells, corpus, lookup, qa, signals, table
from quarry.sources import artifacts, feeds
from quarry.storage import new_path
from quarry.streaming.increment import read_stage
from quarry.streaming.runs import RECORD, RunLog, assemble
from quarry.streaming.stages import run_stages

CONDITION_IDS = [c[0] for c in CONDITIONS]


def _vectors(spark, d):
    n = F.col("vec_id")
    return table(spark, d, "embeddings").select(n.alias("doc_id"), "embedding", "label", F.concat(F.lit("C"), (n % 12 + 1).cast("string")).alias("condition_id"))


@query("q100_condition_indexes", """WITH e AS (SELECT vec_id, 'C' || (vec_id % 12 + 1) AS condition_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT e.condition_id, q.vec_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(q.v, e.v), 6) AS similarity FROM e q, e WHERE q.vec_id % 20 = 0)
SELECT condition_id, query_id, (row_number() OVER (PARTITION BY condition_id, query_id ORDER BY similarity DESC, doc_id))::INT AS rank, doc_id, similarity FROM s QUALIFY rank <= 5""")
def q100(spark, d):
    """Twelve indexes, built and kept on disk; every query's five best in each of them."""
    path, vectors = new_path(spark, "indexes"), _vectors(spark, d)
    indexes.build_indexes(vectors, path)
    asked = vectors.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"), F.explode(F.array(*[F.lit(c) for c in CONDITION_IDS])).alias("condition_id"))
    return indexes.top_k_by_condition(spark, path, asked, 5)


def _run_queries(spark, d):
    """Queries on documents: those whose id is divisible by 20 and has a vector."""
    c = corpus(spark, d)
    n = F.col("query_id")
    ids = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
    return ids.join(c, n == F.col("seq")).select(
        "query_id", F.col("title").alias("question"), F.when(n % 3 == 0, "factual").when(n % 3 == 1, "analytical").otherwise("comparative").alias("query_type"), (n % 4 == 0).alias("time_sensitive"), "domain",
        lookup(VOLATILITY_NAME, F.col("domain")).alias("volatility"), F.lit("1-6 months").alias("freshness_window"), F.lit("Academic only").alias("source_config"), F.lit("C7").alias("condition_id"), F.col("text").alias("reference_answer"),
        F.array(F.substring("text", 1, 4)).alias("relevance_keywords"),
    )


AGE_CASE = "CASE domain " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in VOLATILITY_DAYS.items()) + " END"


@query("q107_run_records", f"""WITH {AGED_SQL}, fr AS (SELECT *, CASE WHEN age_days IS NULL THEN 0 ELSE round(greatest(0, least(1, 1 - age_days / ({AGE_CASE}))), 4) END AS freshness FROM aged),
{TOP_SQL},
rep AS (SELECT conv_id, arg_min(text, turn) AS response FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
hit AS (SELECT t.query_id, t.rank, t.similarity, c.id, c.source_name, c.freshness, contains(lower(coalesce(c.title, '') || ' ' || coalesce(c.text, '')), lower(substr(q.text, 1, 4)))::INT AS label
  FROM top t JOIN fr c ON c.seq = t.vec_id JOIN corpus q ON q.seq = t.query_id),
src AS (SELECT query_id, source_name, count(*) AS n FROM hit GROUP BY ALL),
div AS (SELECT query_id, round(-sum(n / t * log2(n / t)) + 0, 6) AS source_diversity FROM (SELECT *, sum(n) OVER (PARTITION BY query_id) AS t FROM src) GROUP BY query_id),
lists AS (SELECT query_id, string_agg(id, ',' ORDER BY rank) AS docs, list_sum(list(similarity ORDER BY rank)) AS s, string_agg(label::VARCHAR, ',' ORDER BY rank) AS labels, round(avg(freshness)::DECIMAL(38,12), 6)::DOUBLE AS avg_freshness FROM hit GROUP BY query_id)
SELECT q.seq AS query_id, q.title AS question, l.docs, round(l.s::DECIMAL(38,12), 5)::DOUBLE AS similarity_sum, l.labels, d.source_diversity, l.avg_freshness, CASE WHEN q.seq % 7 = 3 THEN '' ELSE rep.response END AS response,
  CASE WHEN q.seq % 7 = 3 THEN 'timeout' END AS generation_error, (q.seq % 50 + q.seq * 37 % 400)::DOUBLE AS total_ms
FROM corpus q JOIN lists l ON l.query_id = q.seq JOIN div d ON d.query_id = q.seq JOIN rep ON rep.conv_id = q.seq""")
def q107(spark, d):
    """The run over all queries in batches, each committed to a log; those without a reply stay pending and have no record."""
    asked = _run_queries(spark, d)
    e = table(spark, d, "embeddings")
    # the age is a column of its own, as many branches ask for it
    aged = corpus(spark, d).withColumn("age", dates.age_days(F.col("publication_date"), AS_OF))
    docs = aged.select("id", "title", "text", "source_name", "publication_date", F.round(dates.freshness_linear_volatility(F.col("age"), F.col("domain")), 4).alias("freshness"))
    n = F.col("conv_id")
    failed = n % 7 == 3
    replies = table(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    replies = replies.select(n.alias("query_id"), F.when(~failed, F.col("text")).alias("response"), (n % 50).cast("double").alias("retrieval_ms"), (n * 37 % 400).cast("double").alias("latency_ms"), F.when(failed, "timeout").alias("generation_error"))

    def work(queries):
        hits = top_k(e, queries.join(e, F.col("query_id") == F.col("vec_id")).select("query_id", F.col("embedding").alias("q")), 5, "vec_id", "embedding", "query_id", "q").withColumnRenamed("vec_id", "doc_id")
        return assemble(queries, hits, docs, replies, relevance_label(F.col("title"), F.col("text"), F.col("relevance_keywords")))

    log = RunLog(spark, new_path(spark, "run"), RECORD)
    log.run(asked, work, batch_rows=500, once=True)
    list_of = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    total = F.aggregate("similarities", F.lit(0.0), lambda s, x: s + x)
    return log.records().select(
        "query_id", "question", list_of(F.col("retrieved_docs.id")).alias("docs"), F.round(total.cast("decimal(38,12)"), 5).cast("double").alias("similarity_sum"), list_of(F.col("relevance_labels")).alias("labels"),
        "source_diversity", "avg_freshness", "response", "generation_error", "total_ms",
    )


@query("q009_result_links", f"""WITH p AS (SELECT page_id, html, regexp_extract(trim(url), '^([a-zA-Z]+)://', 1) || '://' || lower(regexp_extract(trim(url), '^[a-zA-Z]+://([^/?#]*)', 1)) AS root FROM pages),
x AS (SELECT page_id, unnest(hs) AS h, unnest(range(len(hs))) AS i, root FROM (SELECT page_id, root, regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1) AS hs FROM p)),
y AS (SELECT page_id, regexp_replace(CASE WHEN starts_with(h, '/') THEN root || h ELSE h END, '#.*$', '') AS link, i FROM x),
z AS (SELECT page_id, arg_min(link, i) AS link, min(i) AS i, lower(link) AS low FROM y WHERE regexp_matches(link, '^https?://') GROUP BY page_id, lower(link)),
h AS (SELECT *, regexp_replace(lower(regexp_extract(link, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM z),
deny(d) AS (SELECT regexp_replace(lower(regexp_extract(trim(url), '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\\.', '') FROM pages WHERE page_id % 9 = 0), allow(a) AS (VALUES ('example.org'), ('example.com')),
k AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM deny WHERE d <> '' AND (host = d OR ends_with(host, '.' || d))) AND EXISTS (SELECT 1 FROM allow WHERE host = a OR ends_with(host, '.' || a))
  AND NOT ({' OR '.join(f"contains(low, '{s}')" for s in SKIPPED)}))
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i))::INT AS place, link FROM k QUALIFY place <= 4""")
def q009(spark, d):
    """Links of pages as of result pages: hosts of one list are denied, domains of another allowed."""
    pages = table(spark, d, "pages")
    deny = pages.where("page_id % 9 = 0").select(urls.host(F.col("url")).alias("host"))
    allow = spark.createDataFrame([("example.org",), ("www.Example.com",)], "host string")
    return crawl.result_links(pages, "page_id", "html", "url", 4, deny, allow)


def _site(spark, d):
    """Pages as a site of forty hosts: the address is a page's first link, every hundred and first page has failed; one row an address."""
    p = feeds.article(table(spark, d, "pages"), "url", "html", 0)
    n = F.col("page_id")
    host = F.concat(F.lit("https://s"), (n % 40).cast("string"), F.lit(".org/"))
    failed = n % 101 == 5
    rows = p.select(n, F.concat(host, F.regexp_extract("html", '<a href="/([^"]*)"', 1)).alias("url"), F.when(failed, "").otherwise(F.col("title")).alias("title"), F.when(failed, "").otherwise(F.col("text")).alias("text"), "html")
    first = rows.groupBy(F.lower(F.trim("url")).alias("key")).agg(F.min("page_id").alias("page_id")).select("page_id")
    return rows, rows.join(first, "page_id", "left_semi")


@query("q011_seed_crawl", f"""WITH raw AS (SELECT page_id, 'https://s' || (page_id % 40) || '.org' AS root, 'https://s' || (page_id % 40) || '.org/' || regexp_extract(html, '<a href="/([^"]*)"', 1) AS url, page_id % 101 = 5 AS failed,
  trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS t, {clean_text_sql('html')} AS x, html FROM pages),
site AS (SELECT page_id, root, url, lower(trim(url)) AS key, CASE WHEN failed THEN '' ELSE t END AS title, CASE WHEN failed THEN '' ELSE x END AS text, html FROM raw),
store AS (SELECT * FROM site QUALIFY row_number() OVER (PARTITION BY key ORDER BY page_id) = 1),
seed AS (SELECT page_id AS place, url, root, key FROM site WHERE NOT ({' OR '.join(f"contains(lower(url), '{s}')" for s in SKIPPED)})),
f1 AS (SELECT s.place, s.url, s.root, s.key, p.title, p.text, p.html, trim(coalesce(p.title, '')) = '' AND trim(coalesce(p.text, '')) = '' AS bad FROM seed s LEFT JOIN store p ON s.key = p.key),
stop AS (SELECT root, min(place) AS ended FROM f1 WHERE bad GROUP BY root),
first AS (SELECT f1.* FROM f1 LEFT JOIN stop USING (root) WHERE ended IS NULL OR place <= ended),
l1 AS (SELECT place, root, url, unnest(hs) AS h, unnest(range(len(hs))) AS i FROM (SELECT *, regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1) AS hs FROM first)),
l2 AS (SELECT place, url AS base, regexp_replace(CASE WHEN starts_with(h, '/') THEN root || h ELSE h END, '#.*$', '') AS link, i FROM l1),
l3 AS (SELECT place, link, min(i) AS i FROM l2 WHERE link <> base AND regexp_matches(link, '^https?://') AND NOT ({' OR '.join(f"contains(lower(link), '{s}')" for s in SKIPPED)}) GROUP BY place, link),
hop AS (SELECT place, link, (row_number() OVER (PARTITION BY place ORDER BY i))::INT AS hop FROM l3 QUALIFY hop <= 16),
every AS (SELECT url, title, text, place, 0 AS hop, key FROM first UNION ALL SELECT h.link, p.title, p.text, h.place, h.hop, p.key FROM hop h JOIN store p ON lower(trim(h.link)) = p.key),
good AS (SELECT *, lower(title || ' ' || substr(text, 1, 500)) AS blob FROM every WHERE trim(title) <> '' OR trim(text) <> '')
SELECT url, title, md5(text) AS digest, place, hop FROM good WHERE NOT ((contains(blob, '404') AND contains(blob, 'not found')) OR contains(blob, 'page not found'))
QUALIFY row_number() OVER (PARTITION BY key ORDER BY place, hop) = 1""")
def q011(spark, d):
    """A crawl of two hops with every page as a seed; a host's first failing seed blocks its later ones."""
    seeds, store = _site(spark, d)
    found = crawl.seed_crawl(seeds.select("url", F.col("page_id").alias("place")), store)
    return found.select("url", "title", F.md5("text").alias("digest"), "place", "hop")


QUESTIONS_SQL = """f AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || id), id) - 1 AS p, count(*) OVER (PARTITION BY domain) AS many FROM corpus),
q AS (SELECT domain, unnest(range(200)) AS i FROM (SELECT DISTINCT domain FROM f WHERE many > 1)),
k AS (SELECT *, CASE WHEN i < 80 THEN 'factual' WHEN i < 150 THEN 'analytical' ELSE 'comparative' END AS query_type, CASE WHEN i < 80 THEN i ELSE 80 + 2 * (i - 80) END AS a FROM q)"""


@query("q182_question_documents", f"""WITH {CORPUS_SQL}, {QUESTIONS_SQL}
SELECT k.domain, k.domain || '_' || query_type || '_' || lpad((i + 1)::VARCHAR, 4, '0') AS query_id, query_type, x.id AS doc1, CASE WHEN query_type <> 'factual' THEN y.id END AS doc2, x.title AS title1, x.publication_date AS date1,
  substr(x.text, 1, CASE WHEN query_type = 'factual' THEN 1000 ELSE 700 END) AS text1, CASE WHEN query_type <> 'factual' THEN y.source_name END AS source_name2, CASE WHEN query_type <> 'factual' THEN substr(y.text, 1, 700) END AS text2
FROM k JOIN f x ON x.domain = k.domain AND x.p = k.a % x.many JOIN f y ON y.domain = k.domain AND y.p = (k.a + 1) % y.many""")
def q182(spark, d):
    """The documents of two hundred questions a domain."""
    found = questions.question_documents(corpus(spark, d), 200)
    return found.select("domain", "query_id", "query_type", F.get("source_doc_ids", F.lit(0)).alias("doc1"), F.get("source_doc_ids", F.lit(1)).alias("doc2"), "title1", "date1", "text1", "source_name2", "text2")


@query("q020_artifacts", "SELECT event_type AS metric, (user_id % 3 + 1)::INT AS level, count(value) AS n FROM events GROUP BY ALL")
def q020(spark, d):
    """Metrics saved as JSON, published as an artifact (#24) and read back through the readers' cache (#20)."""
    path, target = new_path(spark, "metrics") + ".json", new_path(spark, "published")
    cells(spark, d).groupBy("metric", "level").agg(F.sum("n").alias("n")).coalesce(1).write.json(path)
    artifacts.publish(spark, {"metrics": path}, target)
    held = artifacts.Artifacts(spark)
    return held.get(artifacts.published(spark, target)["metrics"]).select("metric", F.col("level").cast("int").alias("level"), "n")


@query("q024_publish", "SELECT * FROM (VALUES ('regions', 'copied', (SELECT count(*) FROM region)), ('customers', 'copied', (SELECT count(*) FROM customer)), ('forecast', 'missing', NULL)) AS t(name, status, n)")
def q024(spark, d):
    """Two tables published as one set and a third that is missing; rows as they are read back."""
    target = new_path(spark, "published")
    report = artifacts.publish(spark, {"regions": f"{d}/region.parquet", "customers": f"{d}/customer.parquet", "forecast": f"{d}/forecast.json"}, target)
    back = None
    for name, path in artifacts.published(spark, target).items():
        one = spark.read.parquet(path).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        back = one if back is None else back.unionByName(one)
    return report.select("name", "status").join(back, "name", "left")


KEPT_SQL = f"""c AS (SELECT * FROM judged WHERE NOT wall AND length(text) >= least_len AND try_cast(publication_date AS DATE) IS NOT NULL AND length(trim(title || ' ' || text)) >= 60 AND lang = 'en' AND {RELEVANT_SQL} AND {DOCS_SQL}),
alone AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY {NORM.format('title || chr(32) || substr(text, 1, 500)')} ORDER BY seq) = 1),
keyed AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN source_type = 'news' THEN {urls.canonical_news_url_sql('url')} ELSE lower(trim(url)) END ORDER BY seq) AS u FROM alone),
content AS (SELECT *, row_number() OVER (PARTITION BY u = 1, {NORM.format("domain || ' ' || source_type || ' ' || title || ' ' || substr(text, 1, 1200)")} ORDER BY seq) AS w FROM keyed),
passed AS (SELECT * FROM content WHERE u = 1 AND w = 1),
final AS (SELECT * FROM passed QUALIFY row_number() OVER (PARTITION BY domain, source_type ORDER BY seq) <= 500)"""


def _collected(spark, d):
    base = new_path(spark, "collection")
    return pipeline.collect(signals(spark, d), base, AS_OF, KEYWORDS, 500), base


@query("q167_collection", f"WITH {CLEANED_SQL}, {KEPT_SQL} SELECT seq, domain, source_type, md5(text) AS digest, round(CASE WHEN age IS NULL THEN 0 ELSE greatest(0, least(1, 1 - age / CASE domain WHEN 'technology' THEN 180 WHEN 'healthcare' THEN 365 ELSE 3650 END)) END, 4) AS freshness_score FROM (SELECT *, date_diff('day', try_cast(publication_date AS DATE), DATE '2024-01-31')::DOUBLE AS age FROM final)")
def q167(spark, d):
    """From raw records to the saved final table."""
    return read_stage(spark, _collected(spark, d)[1], "final").select("seq", "domain", "source_type", F.md5("text").alias("digest"), "freshness_score")


@query("q167_counters", f"""WITH {CLEANED_SQL}, {KEPT_SQL} SELECT * FROM (VALUES ('raw', (SELECT count(*) FROM judged)), ('cleaned', (SELECT count(*) FROM c)), ('deduplicated', (SELECT count(*) FROM alone)),
{', '.join(f"('{r}', 0)" for r in REASONS[:5])}, ('{REASONS[5]}', (SELECT count(*) FROM content WHERE u > 1)), ('{REASONS[6]}', (SELECT count(*) FROM content WHERE u = 1 AND w > 1)), ('quality', (SELECT count(*) FROM passed)), ('final', (SELECT count(*) FROM final))) AS t(stage, n)""")
def q167_counters(spark, d):
    return _collected(spark, d)[0]


@query("q026_chart_means", """WITH r AS (SELECT 'C' || (l_suppkey % 12 + 1) AS condition, l_returnflag AS domain, l_linestatus AS source, least(floor((l_quantity - 1) / 7), 6)::INT AS age_bin, least(floor(l_discount / 0.025), 3)::INT AS sdi_bin, l_tax::DOUBLE AS precision_at_5, l_extendedprice / 100000 AS latency FROM lineitem),
g AS (SELECT age_bin, condition, domain, sdi_bin, source, GROUPING(age_bin, condition, domain, sdi_bin, source) AS gid, count(*) AS n, avg(precision_at_5) AS p, stddev_samp(precision_at_5) AS ps, count(precision_at_5) AS pn, avg(latency) AS l, stddev_samp(latency) AS ls, count(latency) AS ln
  FROM r GROUP BY GROUPING SETS ((condition), (domain), (domain, source), (domain, age_bin), (age_bin, sdi_bin)))
SELECT CASE gid WHEN 23 THEN 'conditions' WHEN 27 THEN 'domains' WHEN 26 THEN 'sources' WHEN 11 THEN 'decay' ELSE 'heat' END AS chart, age_bin, condition, domain, sdi_bin, source, n, round(p::DECIMAL(38,12), 6)::DOUBLE AS precision_at_5, round(coalesce(ps, 0)::DECIMAL(38,12), 6)::DOUBLE AS precision_at_5_std, pn AS precision_at_5_n,
  round(l::DECIMAL(38,12), 6)::DOUBLE AS latency, round(coalesce(ls, 0)::DECIMAL(38,12), 6)::DOUBLE AS latency_std, ln AS latency_n FROM g""")
def q026_means(spark, d):
    """Bars, sources, decay lines and a heat map of all rows, one scan."""
    r = table(spark, d, "lineitem").select(
        F.concat(F.lit("C"), (F.col("l_suppkey") % 12 + 1).cast("string")).alias("condition"), F.col("l_returnflag").alias("domain"), F.col("l_linestatus").alias("source"), charts.bin_of(F.col("l_quantity"), 1.0, 50.0, 7).alias("age_bin"), charts.bin_of(F.col("l_discount"), 0.0, 0.1, 4).alias("sdi_bin"),
        F.col("l_tax").cast("double").alias("precision_at_5"), (F.col("l_extendedprice") / 100000).alias("latency"),
    )
    wanted = {"conditions": ["condition"], "domains": ["domain"], "sources": ["domain", "source"], "decay": ["domain", "age_bin"], "heat": ["age_bin", "sdi_bin"]}
    return charts.chart_frames(r, wanted, ["precision_at_5", "latency"])


@query("q021_saved_tables", "SELECT fmt, n_regionkey AS region, count(*) AS n, sum(n_nationkey)::BIGINT AS keys, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation, (SELECT unnest(['csv', 'json', 'parquet']) AS fmt) GROUP BY ALL")
def q021(spark, d):
    """A table saved as JSON, CSV and Parquet, each replaced as a whole, and read back."""
    base, out = new_path(spark, "saved"), None
    for kind, end in (("json", ".json"), ("csv", ".csv"), ("parquet", "")):
        artifacts.write_table(table(spark, d, "region"), f"{base}/nation{end}")
        artifacts.write_table(table(spark, d, "nation"), f"{base}/nation{end}")
        n = artifacts.read_table(spark, f"{base}/nation{end}").groupBy(F.col("n_regionkey").cast("int").alias("region"))
        one = n.agg(F.count("*").alias("n"), F.sum(F.col("n_nationkey").cast("long")).alias("keys"), F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names")).withColumn("fmt", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("q049_excerpts", "SELECT doc_id, md5(substr(coalesce(text, ''), 1, 1000)) AS whole, md5(substr(coalesce(text, ''), 1, CASE WHEN doc_id % 2 = 0 THEN 700 ELSE 1000 END)) AS cut FROM documents")
def q049(spark, d):
    n = F.when(F.col("doc_id") % 2 == 0, 700).otherwise(1000)
    return table(spark, d, "documents").select("doc_id", F.md5(excerpt(F.col("text"), 1000)).alias("whole"), F.md5(excerpt(F.col("text"), n)).alias("cut"))


PAPER_SQL = "CASE WHEN doc_id % 3 = 0 THEN 'https://arxiv.org/abs/' || source || '/' || doc_id WHEN doc_id % 3 = 1 THEN 'http://arxiv.org/abs/24' || doc_id || 'v1?x=1' ELSE 'https://example.org/' || doc_id END"


@query("q015_pdf_columns", f"""WITH d AS (SELECT doc_id, {PAPER_SQL} AS url, CASE WHEN doc_id % 5 = 0 THEN 'https://arxiv.org/pdf/p-' || doc_id || '+.pdf' END AS given FROM documents),
p AS (SELECT *, coalesce(given, 'https://arxiv.org/pdf/' || nullif(regexp_extract(url, 'arxiv\\.org/abs/([^/?#]+)', 1), '') || '.pdf') AS pdf_url FROM d),
n AS (SELECT *, CASE WHEN pdf_url IS NOT NULL THEN regexp_replace(coalesce(nullif(replace(regexp_extract(pdf_url, 'arxiv\\.org/(?:pdf|abs)/([^/?#]+)', 1), '.pdf', ''), ''), doc_id::VARCHAR), '[^A-Za-z0-9._-]', '_', 'g') || '.pdf' END AS pdf_file_name FROM p)
SELECT doc_id, pdf_url, pdf_file_name, 'raw/pdfs/tech/' || pdf_file_name AS pdf_file_path, CASE WHEN pdf_url IS NOT NULL THEN pdf_file_name IN (SELECT '24' || doc_id || 'v1.pdf' FROM documents WHERE doc_id % 2 = 1) END AS pdf_available FROM n""")
def q015(spark, d):
    """Addresses, names and presence of papers' files (#15)."""
    n = F.col("doc_id")
    s = n.cast("string")
    url = F.when(n % 3 == 0, F.concat(F.lit("https://arxiv.org/abs/"), "source", F.lit("/"), s)).when(n % 3 == 1, F.concat(F.lit("http://arxiv.org/abs/24"), s, F.lit("v1?x=1"))).otherwise(F.concat(F.lit("https://example.org/"), s))
    docs = table(spark, d, "documents").select("doc_id", s.alias("id"), url.alias("url"), F.when(n % 5 == 0, F.concat(F.lit("https://arxiv.org/pdf/p-"), s, F.lit("+.pdf"))).alias("pdf_url"))
    present = table(spark, d, "documents").where("doc_id % 2 = 1").select(F.concat(F.lit("24"), s, F.lit("v1.pdf")).alias("name"))
    return feeds.pdf_columns(docs, "tech", present).select("doc_id", "pdf_url", "pdf_file_name", "pdf_file_path", "pdf_available")


@query("q081_condition_queries", f"WITH b AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'technology' WHEN 1 THEN 'healthcare' ELSE 'history' END AS domain FROM benchmark), c(condition_id, domain) AS (VALUES {', '.join(f"('{c[0]}', '{c[1]}')" for c in CONDITIONS)}) SELECT condition_id, item_id AS query_id, domain FROM c JOIN b USING (domain)")
def q081_rows(spark, d):
    """The queries that each condition is asked: its domain's bank."""
    n = F.col("item_id")
    bank = table(spark, d, "benchmark").select(n.alias("query_id"), F.when(n % 3 == 0, "technology").when(n % 3 == 1, "healthcare").otherwise("history").alias("domain"))
    return experiment.condition_queries(bank)


HELD_SQL = """held AS (SELECT o_orderpriority AS metric, 'C' || (o_custkey % 12 + 1) AS condition_id, ['technology', 'healthcare', 'history'][(o_custkey % 12 // 4 + 1)::INT] AS domain, round(avg(o_totalprice)::DECIMAL(38,12), 4)::DOUBLE AS actual, round(avg(o_orderkey % 2000 + 190000)::DECIMAL(38,12), 4)::DOUBLE AS predicted FROM orders GROUP BY ALL),
marked AS (SELECT *, abs(actual - predicted) > 59500 AS is_boundary FROM held)"""


def _held_out(spark, d):
    n = F.col("o_custkey") % 12
    mean = lambda c: F.round(F.avg(c).cast("decimal(38,12)"), 4).cast("double")
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("metric"), F.concat(F.lit("C"), (n + 1).cast("string")).alias("condition_id"), F.when(n < 4, "technology").when(n < 8, "healthcare").otherwise("history").alias("domain"))
    held = o.agg(mean(F.col("o_totalprice")).alias("actual"), mean(F.col("o_orderkey") % 2000 + 190000).alias("predicted"))
    return held.withColumn("is_boundary", F.abs(F.col("actual") - F.col("predicted")) > 59500)


@query("q163_validation", f"WITH {HELD_SQL} SELECT domain, count(*) FILTER (is_boundary) AS boundary_conditions, count(*) AS n, count(*) FILTER (is_boundary) = 0 AS reliable FROM marked GROUP BY domain")
def q163_validation(spark, d):
    return dashboard.validation_counts(_held_out(spark, d))


@query("q163_boundaries", f"WITH {HELD_SQL} SELECT metric, condition_id, domain, actual, predicted FROM marked WHERE is_boundary")
def q163_boundaries(spark, d):
    return dashboard.boundaries(_held_out(spark, d))


ERRORS_SQL = "err AS (SELECT ['ols', 'rf', 'xgb'][(user_id % 3 + 1)::INT] AS model, event_type AS metric, round(avg(value)::DECIMAL(38,12), 1)::DOUBLE AS mae, round(stddev_samp(value)::DECIMAL(38,12), 1)::DOUBLE AS r2 FROM events WHERE NOT (event_type = 'click' AND user_id % 3 = 1) GROUP BY ALL)"


def _errors(spark, d):
    m = F.col("user_id") % 3
    one = lambda c: F.round(c.cast("decimal(38,12)"), 1).cast("double")
    rows = table(spark, d, "events").where(~((F.col("event_type") == "click") & (m == 1)))
    return rows.groupBy(F.when(m == 0, "ols").when(m == 1, "rf").otherwise("xgb").alias("model"), F.col("event_type").alias("metric")).agg(one(F.avg("value")).alias("mae"), one(F.stddev_samp("value")).alias("r2"))


@query("q163_model_comparison", f"WITH {ERRORS_SQL}, w AS (SELECT metric, {', '.join(f"coalesce(max(mae) FILTER (model = '{m}'), 0) AS {m}_mae" for m in dashboard.MODELS)}, coalesce(max(r2) FILTER (model = 'ols'), 0) AS ols_r2 FROM err GROUP BY metric), b AS (SELECT *, least(nullif(ols_mae, 0), nullif(rf_mae, 0), nullif(xgb_mae, 0)) AS best_mae FROM w) SELECT *, CASE best_mae WHEN ols_mae THEN 'ols' WHEN rf_mae THEN 'rf' ELSE 'xgb' END AS best_model FROM b")
def q163_models(spark, d):
    """Errors of the three kinds of models beside each other, with the best (#163, #165)."""
    return dashboard.model_comparison(_errors(spark, d))


@query("q163_summary", f"WITH {HELD_SQL}, {ERRORS_SQL} SELECT (SELECT count(DISTINCT condition_id) FROM marked) AS conditions, (SELECT count(DISTINCT domain) FROM marked) AS domains, (SELECT count(*) FROM err WHERE model = 'ols') AS n_metrics, (SELECT max(mae) FROM err WHERE model = 'ols') AS most_mae, (SELECT string_agg(domain || '=' || n, ',' ORDER BY domain) FROM (SELECT domain, count(*) AS n FROM marked WHERE is_boundary GROUP BY domain)) AS boundaries, (SELECT round(avg(k), 4) FROM (SELECT event_type, round(avg(value) / 100, 6) AS k FROM events GROUP BY 1)) AS kappa")
def q163_summary(spark, d):
    pairs = table(spark, d, "events").groupBy(F.col("event_type").alias("pair")).agg(F.round(F.avg("value") / 100, 6).alias("kappa"))
    one = dashboard.summary(_errors(spark, d), _held_out(spark, d), pairs)
    text_of = F.array_join(F.transform(F.map_entries("boundary_conditions"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return one.select("conditions", "domains", F.size("metrics").cast("long").alias("n_metrics"), F.array_max(F.transform(F.map_values("metrics"), lambda v: v["mae"])).alias("most_mae"), text_of.alias("boundaries"), "kappa")


@query("q165_importances", "SELECT metric, model, (row_number() OVER (PARTITION BY metric, model ORDER BY importance DESC, feature))::INT AS place, feature, importance FROM (SELECT o_orderpriority AS metric, o_orderstatus AS model, 'f' || (o_custkey % 9) AS feature, count(*)::DOUBLE AS importance FROM orders GROUP BY ALL)")
def q165_importances(spark, d):
    w = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("metric"), F.col("o_orderstatus").alias("model"), F.concat(F.lit("f"), (F.col("o_custkey") % 9).cast("string")).alias("feature")).agg(F.count("*").cast("double").alias("importance"))
    return dashboard.importances(w)


@query("q098_plateaus", """SELECT o_orderkey, CASE WHEN k = 'technical' AND dom = 'technology' THEN least(12, greatest(6, n // 80)) WHEN k = 'technical' AND dom = 'history' THEN least(24, greatest(14, n // 20)) WHEN k = 'technical' THEN least(12, greatest(8, n // 25))
  WHEN k = 'news' AND dom = 'history' THEN least(20, greatest(14, n // 20)) WHEN k = 'news' THEN least(10, greatest(8, n // 14)) WHEN k = 'academic' AND p = 'wikipedia' THEN least(20, greatest(8, n // 25)) WHEN k = 'academic' THEN least(20, greatest(10, n // 12)) ELSE least(40, greatest(12, n // 6)) END::INT AS most
FROM (SELECT o_orderkey, ['technical', 'news', 'academic', 'other'][(o_orderkey % 4 + 1)::INT] AS k, ['technology', 'healthcare', 'history'][(o_orderkey % 3 + 1)::INT] AS dom, CASE WHEN o_custkey % 2 = 0 THEN 'wikipedia' ELSE 'arxiv' END AS p, o_custkey AS n FROM orders)""")
def q098_plateaus(spark, d):
    """After how many keywords without growth each collection stops."""
    n = F.col("o_orderkey")
    kind = F.when(n % 4 == 0, "technical").when(n % 4 == 1, "news").when(n % 4 == 2, "academic").otherwise("other")
    dom = F.when(n % 3 == 0, "technology").when(n % 3 == 1, "healthcare").otherwise("history")
    primary = F.when(F.col("o_custkey") % 2 == 0, "wikipedia").otherwise("arxiv")
    return table(spark, d, "orders").select("o_orderkey", collection.plateau_limit(kind, dom, primary, F.col("o_custkey")).alias("most"))


def _tree_sql(name: str) -> str:
    return f"SELECT condition_id, n_records, '{name}' AS metric, mean, std, n FROM (SELECT condition_id, count(*) AS n_records, {six_sql(f'avg({name})')} AS mean, {six_sql(f'coalesce(stddev_samp({name}), 0)')} AS std, count({name}) AS n FROM per GROUP BY condition_id)"


@query("q121_response_tree", f"WITH per AS (SELECT 'C' || (m.conv_id % 12 + 1) AS condition_id, m.meteor, h.rate AS hallucination_rate, a.share AS source_attribution FROM ({SQL['q112_meteor']}) m JOIN ({HALLUCINATION_SQL}) h USING (conv_id, turn) JOIN ({SQL['q117_attribution']}) a USING (conv_id, turn)) " + " UNION ALL ".join(map(_tree_sql, experiment.RESPONSE)))
def q121_response(spark, d):
    """The conditions' tree of what is measured of responses."""
    pairs = qa(spark, d).withColumn("condition_id", F.concat(F.lit("C"), (F.col("conv_id") % 12 + 1).cast("string")))
    sources = F.array(F.lit("THE"), F.substring("question", 1, 3), F.substring("reference", 1, 2), F.lit(""))
    found = experiment.response_metrics(pairs, ["condition_id", "conv_id", "turn"], passages=F.array("reference", "question"), sources=sources)
    tree = experiment.condition_tree(found, experiment.RESPONSE)
    return tree.select("condition_id", "n_records", F.explode("metrics").alias("metric", "s")).select("condition_id", "n_records", "metric", "s.mean", "s.std", "s.n")


@query("q189_stages", f"""WITH {BUILT_SQL}, n AS (SELECT condition_id, domain, count(*) AS n FROM built GROUP BY ALL) SELECT * FROM (VALUES ('corpus', 'kept', (SELECT count(*) FROM corpus)), ('conditions', 'made', (SELECT count(*) FROM built)), ('counts', 'made', (SELECT count(*) FROM n))) AS t(stage, status, rows)""")
def q189(spark, d):
    """An experiment's stages: the first is made before, the run goes on with the others."""
    base = new_path(spark, "stages")
    stages = [
        ("corpus", lambda t: corpus(spark, d)),
        ("conditions", lambda t: build_conditions(t["corpus"], AS_OF, 100).select("condition_id", "domain", "rank", "seq")),
        ("counts", lambda t: t["conditions"].groupBy("condition_id", "domain").agg(F.count("*").alias("n"))),
    ]
    run_stages(spark, stages[:1], base)
    return run_stages(spark, stages, base).select("stage", "status", "rows")
