"""Queries over runs of a retrieval experiment and over the control of collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import collection as co
from quarry.operators import experiment as ex
from quarry.operators.retrieval import six_sql
from quarry.plans.registry import query
from quarry.schema import CONDITIONS, VOLATILITY_NAME, table

NAMES = ["precision_at_5", "ndcg_at_5", "avg_freshness", "source_diversity", "avg_similarity"]


def runs(spark, d):
    """Line items as retrieved rows: an order is a query, its lines are the documents; two of fourteen conditions are unknown."""
    n = F.col("l_orderkey")
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("C"), (n % 14 + 1).cast("string")).alias("condition_id"),
        n.alias("query_id"),
        F.col("l_linenumber").alias("rank"),
        F.when(n % 11 != 3, F.col("l_discount") * 10).alias("similarity"),
        (F.col("l_returnflag") == "A").cast("int").alias("relevant"),
        F.when(F.col("l_tax") > 0.02, F.col("l_tax") * 10).alias("freshness"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string")).alias("source_name"),
    )


RUNS_SQL = """runs AS (SELECT 'C' || (l_orderkey % 14 + 1) AS condition_id, l_orderkey AS query_id, l_linenumber AS rank, CASE WHEN l_orderkey % 11 <> 3 THEN l_discount * 10 END AS similarity,
  (l_returnflag = 'A')::INT AS relevant, CASE WHEN l_tax > 0.02 THEN l_tax * 10 END AS freshness, 's' || (l_suppkey % 4) AS source_name FROM lineitem),
lists AS (SELECT condition_id, query_id, list(relevant ORDER BY rank, relevant, source_name) AS ls, round((avg(coalesce(freshness, 0)))::DECIMAL(38,12), 6)::DOUBLE AS avg_freshness, round((coalesce(avg(similarity), 0.1))::DECIMAL(38,12), 6)::DOUBLE AS avg_similarity,
  round(coalesce(min(similarity), 0.05), 6) AS min_similarity, count(*) FILTER (relevant >= 0.5) AS relevant_doc_count, count(*) AS n_docs FROM runs GROUP BY ALL),
ent AS (SELECT condition_id, query_id, round(-sum(p * log2(p)) + 0.0, 6) AS source_diversity FROM (SELECT condition_id, query_id, count(*) / sum(count(*)) OVER (PARTITION BY condition_id, query_id) AS p FROM runs GROUP BY condition_id, query_id, source_name) GROUP BY ALL),
per AS (SELECT condition_id, query_id, round(list_sum(ls[1:5]) / len(ls[1:5]), 6) AS precision_at_5,
  round(coalesce(list_sum(list_transform(ls[1:5], lambda x, i: x / log2(i + 1))) / nullif(list_sum(list_transform(list_reverse_sort(ls)[1:5], lambda x, i: x / log2(i + 1))), 0), 0), 6) AS ndcg_at_5,
  avg_freshness, source_diversity, avg_similarity, min_similarity, relevant_doc_count, n_docs FROM lists JOIN ent USING (condition_id, query_id))"""
TREE_SQL = RUNS_SQL + ", tree AS (" + " UNION ALL ".join(f"SELECT condition_id, count(*) AS n_records, '{n}' AS metric, {six_sql(f'avg({n})')} AS mean, {six_sql(f'coalesce(stddev_samp({n}), 0)')} AS std, count({n}) AS n FROM per GROUP BY condition_id" for n in NAMES) + ")"
META_SQL = "meta(condition_id, domain, volatility, freshness_window, source_config) AS (VALUES " + ", ".join(f"('{c[0]}', '{c[1]}', '{VOLATILITY_NAME[c[1]]}', '{c[2]}', '{c[6]}')" for c in CONDITIONS) + ")"


@query("q122_query_metrics", f"WITH {RUNS_SQL} SELECT * FROM per")
def q122(spark, d):
    """Metrics of a query, mean freshness #104 and recomputed entropy #122 among them."""
    return ex.query_metrics(runs(spark, d))


def _tree(spark, d):
    return ex.condition_tree(ex.query_metrics(runs(spark, d)), NAMES)


@query("q121_condition_tree", f"WITH {TREE_SQL} SELECT * FROM tree")
def q121(spark, d):
    flat = _tree(spark, d).select("condition_id", "n_records", F.explode("metrics").alias("metric", "x"))
    return flat.select("condition_id", "n_records", "metric", "x.mean", "x.std", "x.n")


@query("q180_metric_mean", f"WITH {TREE_SQL} SELECT condition_id, max(mean) FILTER (metric = 'ndcg_at_5') AS ndcg, NULL::DOUBLE AS bert FROM tree GROUP BY condition_id")
def q180(spark, d):
    """A metric that the tree lacks is null."""
    return _tree(spark, d).select("condition_id", ex.metric_mean("ndcg_at_5").alias("ndcg"), ex.metric_mean("bertscore_f1").alias("bert"))


WIDE_SQL = ", ".join(f"max(mean) FILTER (metric = '{n}') AS {n}, max(std) FILTER (metric = '{n}') AS {n}_std" for n in NAMES)


@query("q123_condition_frame", f"WITH {TREE_SQL}, {META_SQL} SELECT condition_id, coalesce(any_value(domain), '') AS domain, coalesce(any_value(volatility), '') AS volatility, coalesce(any_value(freshness_window), '') AS freshness_window, coalesce(any_value(source_config), '') AS source_config, any_value(n_records) AS n_records, {WIDE_SQL}, 0.0::DOUBLE AS human_eval_score, 0.0::DOUBLE AS human_eval_score_std FROM tree LEFT JOIN meta USING (condition_id) GROUP BY condition_id")
def q123(spark, d):
    """Wide frame #123 with metadata #76; a metric that is missing is 0."""
    return ex.condition_frame(_tree(spark, d), [*NAMES, "human_eval_score"])


FLAT_SQL = f"{TREE_SQL}, {META_SQL}, flat AS (SELECT condition_id, coalesce(any_value(domain), '') AS domain, any_value(n_records) AS n_records, {WIDE_SQL} FROM tree LEFT JOIN meta USING (condition_id) GROUP BY condition_id)"


@query("q165_domain_means", f"WITH {FLAT_SQL} SELECT domain, count(*) AS n_conditions, sum(n_records)::BIGINT AS n_records, {", ".join(f"{six_sql(f'avg({n})')} AS {n}" for n in NAMES)} FROM flat WHERE domain <> '' GROUP BY domain")
def q165(spark, d):
    """A dashboard's means over conditions."""
    return ex.domain_means(ex.condition_frame(_tree(spark, d), NAMES), NAMES)


@query("q163_overview", f"WITH {FLAT_SQL} SELECT count(*) AS n_conditions, sum(n_records)::BIGINT AS n_records, count(DISTINCT domain) AS n_domains, arg_min(condition_id, (-precision_at_5, condition_id)) AS best_condition, max(precision_at_5) AS precision_at_5 FROM flat")
def q163(spark, d):
    return ex.overview(ex.condition_frame(_tree(spark, d), NAMES), "precision_at_5")


FACTORS = {"fresh_x_diversity": "f * s", "fresh_x_volatility": "f * v", "source_x_volatility": "s * v", "freshness_score_sq": "f * f", "source_diversity_index_sq": "s * s", "domain_volatility_sq": "v * v"}


@query("q143_query_frame", f"WITH {RUNS_SQL}, {META_SQL}, q AS (SELECT per.*, coalesce(domain, '') AS domain, avg_freshness AS f, source_diversity AS s, CASE domain WHEN 'technology' THEN 1.0 WHEN 'healthcare' THEN 0.5 WHEN 'history' THEN 0.0 ELSE 0.5 END::DOUBLE AS v FROM per LEFT JOIN meta USING (condition_id)) SELECT query_id, condition_id, domain, f AS freshness_score, s AS source_diversity_index, v AS domain_volatility, avg_similarity, min_similarity, relevant_doc_count, {', '.join(f'round({e}, 6) AS {k}' for k, e in FACTORS.items())}, CASE WHEN query_id % 3 = 0 THEN query_id % 7 / 7.0::DOUBLE END AS bertscore_f1 FROM q")
def q143(spark, d):
    """Model rows by query; a target that was not measured is null."""
    per = ex.query_metrics(runs(spark, d))
    measured = per.where("query_id % 3 = 0").select("condition_id", "query_id", (F.col("query_id") % 7 / F.lit(7.0)).alias("bertscore_f1"))
    names = ["query_id", "condition_id", "domain", "freshness_score", "source_diversity_index", "domain_volatility", "avg_similarity", "min_similarity", "relevant_doc_count"]
    return ex.query_frame(per, measured).select(*names, *[F.round(c, 6).alias(c) for c in FACTORS], "bertscore_f1")


@query("q082_zipped", "WITH l AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS a, list(l_quantity ORDER BY l_quantity) FILTER (l_tax > 0.03) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, unnest(range(least(len(a), len(b))))::INT AS place, unnest(a[1:least(len(a), len(b))]) AS a, unnest(b[1:least(len(a), len(b))]) AS b FROM l WHERE len(b) > 0")
def q082(spark, d):
    i = table(spark, d, "lineitem")
    lists = i.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("a"), F.sort_array(F.collect_list(F.when(F.col("l_tax") > 0.03, F.col("l_quantity")))).alias("b"))
    return ex.zipped(lists, "a", "b", ["l_orderkey"])


@query("q185_stratum", "SELECT o_orderkey, k, (dense_rank() OVER (ORDER BY k) - 1)::INT AS label FROM (SELECT o_orderkey, o_orderpriority || '::' || o_orderstatus AS k FROM orders)")
def q185(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", ex.stratum(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("k"))
    return ex.encoded(rows, F.col("k"))


PAIRS_SQL = """r AS (SELECT doc_id % 3 AS crit, 1 + doc_id % 5 AS x, 1 + (doc_id + quality) % 5 AS y FROM labels), j AS (SELECT *, greatest(1, least(5, round_even((x + y) / 2.0, 0)::INT)) AS z FROM r),
p AS (SELECT crit, 'a_b' AS pair, x AS p, y AS q FROM j UNION ALL SELECT crit, 'a_adjudicated', x, z FROM j UNION ALL SELECT crit, 'b_adjudicated', y, z FROM j UNION ALL SELECT crit, 'pooled', x, z FROM j UNION ALL SELECT crit, 'pooled', y, z FROM j),
k AS (SELECT crit, pair, count(*) AS n, avg((p = q)::INT) AS po, """ + " + ".join(f"avg((p = {v})::INT) * avg((q = {v})::INT)" for v in range(1, 6)) + """ AS pe FROM p GROUP BY ALL),
kap AS (SELECT crit, pair, n, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM k)"""


def _bundle(spark, d):
    n = F.col("doc_id")
    rows = table(spark, d, "labels").select((n % 3).alias("crit"), (n % 5 + 1).alias("a"), ((n + F.col("quality")) % 5 + 1).alias("b"))
    return ex.kappa_bundle(rows, "a", "b", ["crit"], [1, 2, 3, 4, 5])


@query("q119_kappa_bundle", f"WITH {PAIRS_SQL} SELECT * FROM kap")
def q119(spark, d):
    return _bundle(spark, d)


@query("q120_gates", f"WITH {PAIRS_SQL} SELECT *, coalesce(kappa >= 0.7, false) AS agrees, n >= 480 AS enough, coalesce(kappa >= 0.7, false) AND n >= 480 AS passed FROM kap")
def q120(spark, d):
    return ex.gates(_bundle(spark, d), "kappa", "n")


@query("q135_profile_ranks", "SELECT event_type AS metric, level, value, (row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN event_type = 'click' THEN value ELSE -value END, level))::INT AS rank FROM (SELECT event_type, (user_id % 3)::INT AS level, round(avg(value), 4) AS value FROM events GROUP BY ALL)")
def q135(spark, d):
    """Rankings of profiles #135: the largest mean first, the least for metrics where lower is better."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("metric"), (F.col("user_id") % 3).cast("int").alias("level")).agg(F.round(F.avg("value"), 4).alias("value"))
    return ex.profile_ranks(e, ["metric"], "level", "value", F.col("metric") == "click")


KIND = "CASE o_orderkey % 3 WHEN 0 THEN 'technical' WHEN 1 THEN 'news' ELSE 'academic' END"
DOM = "CASE o_custkey % 3 WHEN 0 THEN 'technology' WHEN 1 THEN 'healthcare' ELSE 'history' END"


def _joined(parts: list[str]) -> str:
    return "' ' || " + " || ' ' || ".join("'" + p.replace("'", "''") + "'" for p in parts)


@query("q047_search_queries", f"SELECT o_orderkey, 'K' || o_orderkey || CASE dom WHEN 'technology' THEN ' {co.NEWS_ANCHORS['technology']}' WHEN 'healthcare' THEN ' {co.NEWS_ANCHORS['healthcare']} {co.NEWS_NEGATIVES['healthcare']}' ELSE ' {co.NEWS_ANCHORS['history']} {co.NEWS_NEGATIVES['history']}' END AS news, 'K' || o_orderkey || ' ' || dom || CASE WHEN kind = 'technical' AND dom = 'technology' THEN ' official documentation developer guide api reference sdk quickstart tutorial -wikipedia -news -finance' WHEN kind = 'technical' AND dom = 'history' THEN {_joined(co.SEARCH_PARTS[('technical', 'history')])} WHEN kind = 'news' AND dom = 'history' THEN ' heritage archive museum archaeology repatriation historical records policy update -sports -score -match -site:support.google.com -site:maps.google.com -site:youtube.com -site:netflix.com -site:rottentomatoes.com' ELSE ' ' || kind END AS web FROM (SELECT o_orderkey, {KIND} AS kind, {DOM} AS dom FROM orders)")
def q047(spark, d):
    """News and web queries: words that stand twice are kept once in the web query."""
    o = table(spark, d, "orders").select("o_orderkey", F.expr(KIND).alias("kind"), F.expr(DOM).alias("dom"))
    key = F.concat(F.lit("K"), F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", co.news_query(key, F.col("dom")).alias("news"), co.collection_query(key, F.col("dom"), F.col("kind")).alias("web"))


@query("q090_merged_keywords", "WITH l AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_returnflag) AS a, list(lower(l_linestatus) ORDER BY l_linenumber, l_linestatus) AS b FROM lineitem GROUP BY 1), x AS (SELECT l_orderkey, unnest(a || b) AS k, unnest(range(len(a || b))) AS p FROM l), f AS (SELECT l_orderkey, k, min(p) AS p FROM x GROUP BY ALL) SELECT l_orderkey, string_agg(k, ',' ORDER BY p) AS merged FROM f GROUP BY 1")
def q090(spark, d):
    pick = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col(c).alias("x")))), lambda s: s["x"])
    i = table(spark, d, "lineitem").groupBy("l_orderkey").agg(pick("l_returnflag").alias("a"), F.transform(pick("l_linestatus"), lambda s: F.lower(s)).alias("b"))
    return i.select("l_orderkey", F.array_join(co.merged_keywords(F.col("a"), F.col("b")), ",").alias("merged"))


@query("q098_sizes", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN greatest(10, least(24, greatest(12, t // 85))) WHEN 1 THEN greatest(18, least(45, greatest(22, t // 35))) ELSE greatest(16, least(36, greatest(20, t // 45))) END::INT AS academic, greatest(12, least(36, greatest(16, t // 40)))::INT AS technical, greatest(18, least(40, greatest(12, t // 40 + 4)))::INT AS web, greatest(14, least(48, t // 40 + 8))::INT AS refill FROM (SELECT o_orderkey, o_custkey % 3000 AS t FROM orders)")
def q098(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 3000).alias("t"))
    n, t = F.col("o_orderkey") % 3, F.col("t")
    primary = F.when(n == 0, "wikipedia").when(n == 1, "pubmed").otherwise("arxiv")
    return o.select("o_orderkey", co.academic_size(primary, t).alias("academic"), co.technical_size(t).alias("technical"), co.web_target(F.floor(t / 40)).alias("web"), co.refill_target(F.floor(t / 40)).alias("refill"))


def _news(spark, d):
    """Orders as rows that feeds have found, a customer's group being a keyword."""
    n = F.col("o_orderkey")
    provider = F.when(n % 4 == 0, "gdelt").when(n % 2 == 1, "google").otherwise("bing")
    return table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("keyword"), provider.alias("provider"), F.when(n % 4 == 0, 0).otherwise((n % 3).cast("int")).alias("variant"), n.alias("seq"), F.when(n % 9 != 5, (F.col("o_custkey") * 31 % 97).cast("string")).alias("key"))


FOUND_SQL = """found AS (SELECT o_custkey % 50 AS keyword, CASE WHEN o_orderkey % 4 = 0 THEN 'gdelt' WHEN o_orderkey % 2 = 1 THEN 'google' ELSE 'bing' END AS provider,
  CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 3 END::INT AS variant, o_orderkey AS seq, CASE WHEN o_orderkey % 9 <> 5 THEN (o_custkey * 31 % 97)::VARCHAR END AS key FROM orders),
nth AS (SELECT *, row_number() OVER (PARTITION BY keyword, provider, variant ORDER BY seq) AS nth, CASE provider WHEN 'google' THEN 0 ELSE 1 END AS f FROM found)"""
FIRST_SQL = "won AS (SELECT *, row_number() OVER (PARTITION BY keyword, key ORDER BY a, v, f, seq) AS g FROM taken WHERE key IS NOT NULL), done AS (SELECT keyword, provider, variant, seq, key, (row_number() OVER (PARTITION BY keyword ORDER BY a, v, f, seq))::INT AS rank FROM won WHERE g = 1) SELECT * FROM done WHERE rank <= {0}"


@query("q174_news_gdelt", f"WITH {FOUND_SQL}, taken AS (SELECT *, CASE provider WHEN 'gdelt' THEN 0 ELSE 1 END AS a, 0 AS v FROM nth WHERE (provider = 'gdelt' AND nth <= 24) OR (provider <> 'gdelt' AND variant = 0 AND nth <= 6)), " + FIRST_SQL.format(24))
def q174_gdelt(spark, d):
    return co.news_union(_news(spark, d), 24, "gdelt")


@query("q174_news_hybrid", f"WITH {FOUND_SQL}, rss AS (SELECT *, 0 AS a, variant AS v FROM nth WHERE provider <> 'gdelt' AND variant < 3 AND nth <= 14), have AS (SELECT keyword, count(*) AS have FROM rss GROUP BY 1), taken AS (SELECT * FROM rss UNION ALL SELECT n.*, 1, variant FROM nth n LEFT JOIN have USING (keyword) WHERE provider = 'gdelt' AND coalesce(have, 0) < 80 AND nth <= greatest(6, least(20, 80 - coalesce(have, 0)))), " + FIRST_SQL.format(32))
def q174_hybrid(spark, d):
    """Three query variants, whose budgets are clamped to 14, and the other feed where they fall short of eighty."""
    return co.news_union(_news(spark, d), 80, "hybrid", queries=3)


@query("q174_news_rss", f"WITH {FOUND_SQL}, taken AS (SELECT *, 0 AS a, variant AS v FROM nth WHERE provider <> 'gdelt' AND variant < 2 AND nth <= 12), " + FIRST_SQL.format(24))
def q174_rss(spark, d):
    """Both RSS feeds, two query variants."""
    return co.news_union(_news(spark, d), 24, "rss", queries=2)


@query("q174_news_history", f"WITH {FOUND_SQL}, t AS (SELECT *, 0 AS a, variant AS v FROM nth WHERE provider <> 'gdelt' AND variant < 1 AND nth <= 6), one AS (SELECT keyword, key FROM t WHERE coalesce(key, '') <> '' GROUP BY ALL), few AS (SELECT keyword FROM (SELECT DISTINCT keyword FROM nth) LEFT JOIN (SELECT keyword, least(count(*), 8) AS n FROM one GROUP BY keyword) USING (keyword) WHERE coalesce(n, 0) < 8), taken AS (SELECT * FROM t UNION ALL SELECT nth.*, 1, variant FROM nth JOIN few USING (keyword) WHERE provider = 'gdelt' AND nth <= 8), lim AS (SELECT keyword, CASE WHEN keyword IN (SELECT keyword FROM few) THEN 16 ELSE 8 END AS most FROM (SELECT DISTINCT keyword FROM nth)), " + FIRST_SQL.replace("SELECT * FROM done WHERE rank <= {0}", "SELECT keyword, provider, variant, seq, key, rank FROM done JOIN lim USING (keyword) WHERE rank <= most"))
def q174_history(spark, d):
    """Both RSS feeds, and the other feed for keywords that have fewer than eight rows then."""
    return co.news_union(_news(spark, d), 8, "rss", history=True, least=8)


@query("q166_rounds", "WITH a AS (SELECT (o_orderkey % 12)::INT AS round, o_orderkey AS seq, (o_custkey % 900)::VARCHAR AS key FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY seq) AS nth FROM a), c AS (SELECT * FROM n WHERE nth <= 600), f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round, seq) AS g FROM c), r AS (SELECT round, count(*) FILTER (g = 1) AS new FROM f GROUP BY 1), s AS (SELECT *, sum(new) OVER (ORDER BY round) AS total, sum((new = 0)::INT) OVER (ORDER BY round ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS dry, row_number() OVER (ORDER BY round) AS no FROM r), stop AS (SELECT min(round) AS stop FROM s WHERE total >= 400 OR (dry = 2 AND no >= 2)), p AS (SELECT round, seq, key, (row_number() OVER (ORDER BY round, seq))::BIGINT AS place FROM f, stop WHERE g = 1 AND (stop IS NULL OR round <= stop)) SELECT * FROM p WHERE place <= 400")
def q166(spark, d):
    """Rounds until twice the target or a plateau of two."""
    n = F.col("o_orderkey")
    return co.collect_rounds(table(spark, d, "orders").select((n % 12).cast("int").alias("round"), n.alias("seq"), (F.col("o_custkey") % 900).cast("string").alias("key")), 200, 2)


@query("q168_policy_fill", "WITH e AS (SELECT doc_id, quality, 'old' AS kind FROM labels WHERE doc_id % 3 = 0), f AS (SELECT doc_id, quality, 'new' AS kind FROM labels WHERE doc_id % 2 = 0) SELECT * FROM e UNION ALL SELECT * FROM f WHERE doc_id NOT IN (SELECT doc_id FROM e)")
def q168(spark, d):
    """The automatic policy below its target: keys that are missing come in."""
    rows = table(spark, d, "labels").select("doc_id", "quality")
    old, new = rows.where("doc_id % 3 = 0").withColumn("kind", F.lit("old")), rows.where("doc_id % 2 = 0").withColumn("kind", F.lit("new"))
    return co.existing_policy(old, new, "doc_id", "auto", 1 << 40)


@query("q171_query_bank", "WITH c AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'technology' WHEN 1 THEN 'healthcare' ELSE 'history' END AS domain, o_orderkey AS query_id, ['factual', 'analytical', 'comparative'][(o_custkey % 3 + 1)::INT] AS query_type, o_orderkey % 13 = 0 AS ts, ['low', 'medium', 'high'][(o_custkey % 7 % 3 + 1)::INT] AS risk FROM orders), n AS (SELECT *, md5(domain || ':' || query_id) AS h FROM c), m AS (SELECT *, row_number() OVER (PARTITION BY domain, query_type ORDER BY h, query_id) AS nth FROM n), b AS (SELECT * FROM m WHERE nth <= CASE query_type WHEN 'factual' THEN 160 WHEN 'analytical' THEN 140 ELSE 100 END), w AS (SELECT *, floor(count(*) OVER (PARTITION BY domain) * 0.2) - sum(ts::INT) OVER (PARTITION BY domain) AS need, sum((NOT ts AND risk IN ('low', 'medium'))::INT) OVER (PARTITION BY domain ORDER BY h, query_id ROWS UNBOUNDED PRECEDING) AS place FROM b) SELECT domain, query_id, query_type, risk, (NOT ts AND risk IN ('low', 'medium') AND place <= need) AS promoted, ts OR (NOT ts AND risk IN ('low', 'medium') AND place <= need) AS time_sensitive FROM w")
def q171(spark, d):
    n, k = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    rows = table(spark, d, "orders").select(pick(["technology", "healthcare", "history"], n % 3).alias("domain"), n.alias("query_id"), pick(["factual", "analytical", "comparative"], k % 3).alias("query_type"), (n % 13 == 0).alias("time_sensitive"), pick(["low", "medium", "high"], k % 7 % 3).alias("risk"))
    return co.query_bank(rows, 400)


@query("q178_final_url", "WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://www.bing.com/news/apiclick.aspx?url=http://t.org/' || (page_id % 5) ELSE 'http://t.org/' || (page_id % 5) END AS u, 'http://t.org/' || (page_id % 5) AS first FROM pages) SELECT page_id, CASE WHEN page_id % 5 < 2 THEN 'https://end.org/' || (page_id % 5) ELSE first END AS final_url FROM p")
def q178(spark, d):
    """Unwrapped, then sent on where a redirect is known."""
    n = F.col("page_id")
    plain = F.concat(F.lit("http://t.org/"), (n % 5).cast("string"))
    rows = table(spark, d, "pages").select("page_id", F.when(n % 3 == 0, F.concat(F.lit("https://www.bing.com/news/apiclick.aspx?url="), plain)).otherwise(plain).alias("u"))
    redirects = spark.createDataFrame([(f"http://t.org/{k}", f"https://end.org/{k}") for k in range(2)] + [("http://t.org/3", "")], "source string, target string")
    return co.final_url(rows, "u", redirects).select("page_id", "final_url")
