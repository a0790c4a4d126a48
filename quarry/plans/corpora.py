"""Queries over classifiers, the quality cascade, dedup and conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import dates, terms, text, urls
from quarry.operators import conditions as cond
from quarry.operators import crawl, dedup, experiment, keywords, quality
from quarry.plans.registry import query
from quarry.plans.texts import CASE_DAYS, NORM
from quarry.schema import AGED_SQL, AS_OF, CONDITIONS, CORPUS_SQL, SIGNALS_SQL, conditions, corpus, signals, table
from quarry.storage import spread

BLOB = NORM.format("title || ' ' || text")
#: Keywords of the synthetic collections; they are a parameter of every operator.
KEYWORDS = {"technology": ["language model systems", "vector database"], "healthcare": ["clinical decision support", "remote patient monitoring"], "history": ["archival collections", "industrial revolution"]}


def hits_sql(blob: str = "blob", domain: str = "domain") -> str:
    return f"CASE {domain} " + " ".join(f"WHEN '{n}' THEN {terms.count_parts_sql(blob, terms.domain_terms(n, KEYWORDS[n]))}" for n in terms.DOMAIN_HINTS) + " END"


#: Everything that the classifiers need of a signals row: n, blobs, counts.
COUNTED_SQL = SIGNALS_SQL + f""", blobs AS (SELECT *, {BLOB} AS blob, {NORM.format('title')} AS head, {NORM.format('text')} AS body, lower(trim(url)) AS link FROM signals),
counted AS (SELECT *, {hits_sql()} AS hits, regexp_matches(blob, '{terms.bounded('|'.join(terms.OFFTOPIC))}') AS offtopic,
  CASE WHEN domain = 'history' THEN 1 ELSE 2 END AS least,
  {terms.count_terms_sql('blob', terms.HEALTHCARE_CORE)} AS care, {terms.count_terms_sql('blob', terms.FINANCE_NOISE)} AS finance,
  {terms.count_terms_sql('blob', terms.HISTORY_CORE)} AS past, {terms.count_terms_sql('blob', terms.HISTORY_NOISE)} AS past_noise,
  {terms.count_parts_sql('link', terms.TECH_URL)} AS tu, {terms.count_terms_sql('head', terms.TECH_TITLE)} AS tt,
  {terms.count_terms_sql('blob', terms.TECH_TEXT)} AS tx, {terms.count_terms_sql('blob', terms.TECH_NOISE)} AS tn,
  {terms.count_parts_sql('link', terms.HISTORY_URL)} AS hu, {terms.count_terms_sql('head', terms.HISTORY_STRUCTURE)} AS hs, {terms.count_terms_sql('blob', terms.HISTORY_STRUCTURE)} AS hx,
  {terms.count_parts_sql('link', terms.WALL_URL)} AS wu, {terms.count_terms_sql('head', terms.WALL_TITLE)} AS wt, {terms.count_terms_sql('body', terms.WALL_TEXT)} AS wx,
  len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS words FROM blobs),
judged AS (SELECT *,
  hits >= least AND (NOT offtopic OR hits >= least + 1) AND CASE domain WHEN 'healthcare' THEN care >= 2 AND NOT (finance >= 4 AND care <= 3)
    WHEN 'history' THEN past >= greatest(1, least) AND NOT (past_noise >= 3 AND past <= 3) ELSE true END AS news_ok,
  CASE WHEN tn >= 3 AND tu + tt = 0 THEN false WHEN tn >= 2 AND tx <= 2 THEN false WHEN tu + tt = 0 THEN false WHEN tx >= 2 THEN true
    WHEN tu >= 2 AND tx >= 1 AND tn = 0 THEN true ELSE false END AS tech_ok,
  CASE WHEN past_noise >= 3 AND hu = 0 AND hs = 0 THEN false WHEN hu >= 1 THEN true WHEN hs >= 1 AND (hx >= 1 OR past >= 1) THEN true WHEN past >= 2 THEN true ELSE hx >= 3 END AS history_ok,
  wu > 0 OR wt > 0 OR (wx >= 2 AND words <= 500) AS wall,
  CASE WHEN source_type IN ('academic', 'news') THEN 120 ELSE 200 END AS least_len FROM counted)"""


@query("q060_domain_hits", f"WITH {COUNTED_SQL} SELECT seq, hits::INT AS hits, hits >= least AS relevant, offtopic FROM counted")
def q060(spark, d):
    """Terms #59, hits #60, relevance #61 and sports news #62."""
    blob = F.concat_ws(" ", "title", "text")
    s = signals(spark, d).select("seq", "domain", terms.domain_hits(blob, F.col("domain"), KEYWORDS).alias("hits"), terms.is_offtopic(blob).alias("offtopic"))
    return s.select("seq", "hits", (F.col("hits") >= terms.min_hits(F.col("domain"))).alias("relevant"), "offtopic")


@query("q037_term_present", f"WITH {COUNTED_SQL} SELECT seq, regexp_matches(blob, '{terms.term_pattern('public health')}') AS a, regexp_matches(blob, '{terms.term_pattern('health care')}') AS b FROM blobs")
def q037(spark, d):
    blob = text.normalize_text(F.concat_ws(" ", "title", "text"))
    return signals(spark, d).select("seq", terms.has_term(blob, "public health").alias("a"), terms.has_term(blob, "health care").alias("b"))


@query("q063_classifiers", f"WITH {COUNTED_SQL} SELECT seq, news_ok AS news, tech_ok AS tech, history_ok AS history, wall FROM judged")
def q063(spark, d):
    """News relevance #63, documentation #64 and #65, challenge pages #66."""
    rows = terms.counted(spread(signals(spark, d)), KEYWORDS)
    return rows.select("seq", terms.news_relevant().alias("news"), terms.tech_documentation().alias("tech"), terms.history_documentation().alias("history"), terms.is_interstitial().alias("wall"))


@query("q067_docs_candidate", "SELECT page_id, NOT contains(lower(trim(url)), 'utm_') AND (regexp_matches(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', ''), '(^|\\.)example\\.org$') OR contains(lower(trim(url)), 'ref=')) AS ok FROM pages")
def q067(spark, d):
    return table(spark, d, "pages").select("page_id", terms.is_docs_candidate(F.col("url"), ["example.org"], ["utm_"], ["ref="]).alias("ok"))


CLEAN = text.clean_text_sql
CLEANED_SQL = COUNTED_SQL.replace("FROM signals)", f"FROM (SELECT * REPLACE ({CLEAN('title')} AS title, {CLEAN('text')} AS text) FROM signals))", 1)
RELEVANT_SQL = "CASE WHEN source_type = 'news' THEN news_ok ELSE hits >= least END"
DOCS_SQL = "CASE WHEN source_type = 'technical' AND domain = 'technology' THEN CASE WHEN lower(trim(source_name)) = 'wikipedia' THEN false WHEN lower(trim(source_name)) IN ('googlesearch', 'bingsearch') THEN tech_ok ELSE true END ELSE true END"


@query("q068_clean_data", f"WITH {CLEANED_SQL} SELECT seq, md5(text) AS digest FROM judged WHERE NOT wall AND length(text) >= least_len AND try_cast(publication_date AS DATE) IS NOT NULL AND length(trim(title || ' ' || text)) >= 60 AND lang = 'en' AND {RELEVANT_SQL} AND {DOCS_SQL}")
def q068(spark, d):
    return quality.clean_data(signals(spark, d), AS_OF, KEYWORDS).select("seq", F.md5("text").alias("digest"))


REASONS_SQL = CLEANED_SQL + f""", tested AS (SELECT *, CASE WHEN title = '' OR text = '' THEN '{quality.REASONS[0]}' WHEN wall THEN '{quality.REASONS[1]}' WHEN length(text) < least_len THEN '{quality.REASONS[2]}'
  WHEN NOT ({RELEVANT_SQL}) THEN '{quality.REASONS[3]}' WHEN NOT ({DOCS_SQL}) THEN '{quality.REASONS[4]}' END AS r,
  CASE WHEN source_type = 'news' THEN {urls.canonical_news_url_sql('url')} ELSE lower(trim(url)) END AS key FROM judged),
linked AS (SELECT *, r IS NULL AND row_number() OVER (PARTITION BY r IS NULL, key ORDER BY seq) > 1 AS dup FROM tested),
said AS (SELECT *, r IS NULL AND NOT dup AND row_number() OVER (PARTITION BY r IS NULL AND NOT dup, {NORM.format("domain || ' ' || source_type || ' ' || title || ' ' || substr(text, 1, 1200)")} ORDER BY seq) > 1 AS same FROM linked),
reasons AS (SELECT *, coalesce(r, CASE WHEN dup THEN '{quality.REASONS[5]}' WHEN same THEN '{quality.REASONS[6]}' END) AS reason FROM said)"""


@query("q069_quality_reasons", f"WITH {REASONS_SQL} SELECT seq, reason FROM reasons")
def q069(spark, d):
    return quality.quality_reasons(signals(spark, d), KEYWORDS).select("seq", "reason")


@query("q069_drop_counts", f"WITH {REASONS_SQL} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM reasons GROUP BY ALL")
def q069b(spark, d):
    return quality.drop_counts(quality.quality_reasons(signals(spark, d), KEYWORDS))


@query("q175_drop_total", f"WITH {REASONS_SQL} SELECT domain, source_type, count(*) FILTER (reason IS NOT NULL) AS dropped, count(*) FILTER (reason IS NULL) AS kept, max(CASE WHEN source_type IN ('academic', 'news') THEN 120 ELSE 200 END)::INT AS least_len FROM reasons GROUP BY ALL")
def q175(spark, d):
    r = quality.quality_reasons(signals(spark, d), KEYWORDS)
    return r.groupBy("domain", "source_type").agg(F.count_if(F.col("reason").isNotNull()).alias("dropped"), F.count_if(F.col("reason").isNull()).alias("kept"), F.max(quality.least_length(F.col("source_type"))).alias("least_len"))


@query("q070_should_enrich", f"WITH {CORPUS_SQL} SELECT seq FROM corpus WHERE length(trim(text)) < 300 AND source_type <> 'academic'")
def q070(spark, d):
    return quality.should_enrich(corpus(spark, d)).select("seq")


CONDITION_ROWS = ", ".join(f"({i + 1}, '{c[0]}', '{c[1]}', '{c[2]}', {c[3]}, {'NULL' if c[4] is None else c[4]}, {c[5]!r}, {i % 3 + 1})" for i, c in enumerate(CONDITIONS))
CANDIDATES_SQL = AGED_SQL + f""", conditions(position, condition_id, cdomain, label, lo, hi, mix, level) AS (VALUES {CONDITION_ROWS}),
dim AS (SELECT *, unnest(mix) AS kind, unnest(range(len(mix))) AS source_pos FROM conditions),
candidates AS (SELECT * FROM aged a JOIN dim c ON a.domain = c.cdomain AND a.source_type = c.kind
  WHERE age_days * CASE WHEN contains(label, 'adj') THEN CASE a.domain WHEN 'technology' THEN 180 WHEN 'healthcare' THEN 365 ELSE 3650 END / 180.0 ELSE 1 END >= lo
    AND (hi IS NULL OR age_days * CASE WHEN contains(label, 'adj') THEN CASE a.domain WHEN 'technology' THEN 180 WHEN 'healthcare' THEN 365 ELSE 3650 END / 180.0 ELSE 1 END <= hi))"""
BUILT_SQL = CANDIDATES_SQL + """, firsts AS (SELECT *, row_number() OVER (PARTITION BY condition_id, lower(trim(url)) ORDER BY source_pos, seq) AS f FROM candidates),
built AS (SELECT *, (row_number() OVER (PARTITION BY condition_id ORDER BY source_pos, seq))::INT AS rank FROM firsts WHERE f = 1 QUALIFY rank <= 100)"""


@query("q075_condition_candidates", f"WITH {CANDIDATES_SQL} SELECT condition_id, seq, source_pos::INT AS source_pos FROM candidates")
def q075(spark, d):
    """Lookup #74, theta join #75, window match #71, union by source order #88."""
    return cond.candidates(corpus(spark, d), AS_OF).select("condition_id", "seq", "source_pos")


@query("q087_conditions", f"WITH {BUILT_SQL} SELECT condition_id, rank, seq FROM built")
def q087(spark, d):
    return cond.build_conditions(corpus(spark, d), AS_OF, 100).select("condition_id", "rank", "seq")


#: Condition rows of records with signals, numbered in order of conditions, through the cascade.
SIGNALLED_SQL = SIGNALS_SQL + BUILT_SQL[len(CORPUS_SQL) :].replace("FROM corpus", "FROM signals") + ", ordered AS (SELECT * REPLACE ((position * 1000 + rank)::BIGINT AS seq), seq AS doc FROM built)"


@query("q089_combined", f"WITH {SIGNALLED_SQL}{REASONS_SQL[len(SIGNALS_SQL) :].replace('FROM signals)', 'FROM ordered)')} SELECT doc AS seq, position::INT AS position, md5(text) AS digest FROM reasons WHERE reason IS NULL")
def q089(spark, d):
    rows = cond.build_conditions(signals(spark, d), AS_OF, 100)
    return cond.combined(rows, KEYWORDS).select("seq", "position", F.md5("text").alias("digest"))


@query("q072_age_window_count", f"WITH {AGED_SQL} SELECT domain, count(*) FILTER (age_days >= 30 AND age_days <= 180) AS n FROM aged GROUP BY domain")
def q072(spark, d):
    age = dates.age_days(F.col("publication_date"))
    return corpus(spark, d).groupBy("domain").agg(F.count_if(cond.in_window(age, F.lit(30), F.lit(180))).alias("n"))


@query("q073_prioritize", f"WITH {AGED_SQL} SELECT seq, coalesce(age_days <= 365, false) AS in_window, (row_number() OVER (PARTITION BY domain ORDER BY coalesce(age_days <= 365, false) DESC, seq))::INT AS place FROM aged")
def q073(spark, d):
    return cond.prioritized_places(corpus(spark, d), 0, 365, AS_OF, ["domain"]).select("seq", "in_window", "place")


@query("q083_dedup_title_start", f"WITH {CORPUS_SQL} SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY {NORM.format('title || chr(32) || substr(text, 1, 500)')} ORDER BY seq) AS r FROM corpus) WHERE r = 1")
def q083(spark, d):
    return dedup.by_title_and_start(corpus(spark, d)).select("seq")


@query("q084_greedy_leader", None)
def q084(spark, d):
    """Order-dependent near-duplicate removal over all vectors."""
    return dedup.greedy_leader(table(spark, d, "embeddings"), 0.40, seq="vec_id", vec="embedding")


@query("q085_news_candidates", f"WITH {CORPUS_SQL} SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY {urls.canonical_news_url_sql('url')} ORDER BY seq) AS r FROM corpus WHERE source_type = 'news') WHERE r = 1 ORDER BY seq LIMIT 200")
def q085(spark, d):
    return dedup.news_candidates(corpus(spark, d), F.col("source_type") == "news", 200).select("seq")


@query("q086_news_two_keys", f"WITH {CORPUS_SQL}, one AS (SELECT *, row_number() OVER (PARTITION BY {urls.canonical_news_url_sql('url')} ORDER BY seq) AS r FROM corpus), two AS (SELECT *, row_number() OVER (PARTITION BY {NORM.format('title')} ORDER BY seq) AS q FROM one WHERE r = 1) SELECT seq FROM two WHERE q = 1")
def q086(spark, d):
    return dedup.news_by_two_keys(corpus(spark, d)).select("seq")


@query("q023_merge_checkpoint", f"WITH {CORPUS_SQL} SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY lower(trim(url)) ORDER BY CASE WHEN domain = 'history' THEN 1 ELSE 0 END, seq) AS r FROM corpus) WHERE r = 1")
def q023(spark, d):
    c = corpus(spark, d)
    return dedup.merge_checkpoint(c.where("domain <> 'history'"), c.where("domain = 'history'")).select("seq")


@query("q018_domain_docs", f"WITH {CORPUS_SQL} SELECT seq FROM (SELECT seq, publication_date, row_number() OVER (PARTITION BY publication_date ORDER BY seq) AS r FROM corpus) WHERE r = 1 OR publication_date = ''")
def q018(spark, d):
    """Union with first-wins on a key, where empty keys are never merged."""
    return dedup.domain_docs(corpus(spark, d), "publication_date", ["seq"]).select("seq")


@query("q010_ordered_union", f"WITH {CORPUS_SQL} SELECT seq FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(url)) ORDER BY CASE WHEN source_type = 'technical' THEN 0 ELSE 1 END, seq) AS r FROM corpus WHERE source_type <> 'academic') WHERE r = 1")
def q010(spark, d):
    c = corpus(spark, d)
    return crawl.ordered_union([c.where("source_type = 'technical'"), c.where("source_type = 'news'")], F.lower(F.trim("url")), "seq").select("seq")


@query("q012_seed_rotation", "WITH u AS (SELECT *, row_number() OVER (PARTITION BY lower(s) ORDER BY p) AS r FROM (SELECT source, 'https://x.org/' || (doc_id % 7) AS s, doc_id AS p FROM documents)), k AS (SELECT source, s, row_number() OVER (PARTITION BY source ORDER BY p) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM (SELECT *, row_number() OVER (PARTITION BY source, lower(s) ORDER BY p) AS f FROM u) WHERE f = 1) SELECT source, s AS seed, ((i - 3) % n + n) % n AS place FROM k")
def q012(spark, d):
    """Ordered distinct seeds, rotated by an offset of 3."""
    u = table(spark, d, "documents").select("source", F.concat(F.lit("https://x.org/"), (F.col("doc_id") % 7).cast("string")).alias("seed"), F.col("doc_id").alias("p"))
    return crawl.rotated_seeds(u, "source", "seed", "p", 3)


SHORT, LONG, ASKED = ["study", "review", "method", "dataset", "evidence"], ["cohort study", "benchmark dataset evaluation"], ["digital health"]


@query("q094_keyword_pool", "SELECT DISTINCT source, 28::INT AS n, source || ' study' AS second_hint, source || ' academic overview query 1' AS pad, [source, 'health academic', 'health ' || source || ' systematic review and meta analysis methodology'] AS anchors FROM documents")
def q094(spark, d):
    """Pool #94, padding #95 and anchors #96."""
    arr = lambda v: F.array(*[F.lit(x) for x in v])
    base, dom, kind = F.array("source", F.upper("source")), F.lit("health"), F.lit("academic")
    p = keywords.pool(base, dom, arr(SHORT), arr(LONG), arr(ASKED))
    s = table(spark, d, "documents").select("source").distinct().withColumn("p", p)
    pad = keywords.padded(F.col("p"), base, kind, F.size("p") + 5)
    return s.select("source", F.size(pad).alias("n"), F.get("p", 2).alias("second_hint"), F.get(pad, F.size("p")).alias("pad"), keywords.anchors(base, dom, kind).alias("anchors"))


@query("q097_expand_keywords", None)
def q097(spark, d):
    arr = lambda v: F.array(*[F.lit(x) for x in v])
    s = table(spark, d, "documents").select("source").distinct()
    rows = s.select("source", F.array("source").alias("base"), F.lit("technology").alias("domain"), F.lit("technical").alias("kind"), F.lit(1).alias("round"), arr(SHORT).alias("short"), arr(LONG).alias("long"), arr(ASKED).alias("queries"))
    return keywords.expand(rows).select("source", F.size("expanded").alias("n"), "expanded")


@query("q139_build_summary", f"WITH {CORPUS_SQL} SELECT domain, source_type, count(*) AS n, greatest(0, 150 - count(*)) AS shortfall, round(least(100.0, 100.0 * count(*) / 150)::DOUBLE, 2) AS progress, least(150, greatest(250, 60))::INT AS floor FROM corpus GROUP BY ALL")
def q139(spark, d):
    """Sizing #98, strict floor #169, shortfall and progress."""
    n = F.count("*")
    return corpus(spark, d).groupBy("domain", "source_type").agg(n.alias("n"), keywords.shortfall(n, F.lit(150)).alias("shortfall"), keywords.progress(n, F.lit(150)).alias("progress"), keywords.strict_floor(F.lit(150)).alias("floor"))


@query("q138_validation_report", f"""WITH {AGED_SQL}, s AS (SELECT *, CASE WHEN age_days IS NULL THEN 0 ELSE greatest(0, least(1, 1 - age_days / {CASE_DAYS})) END AS score FROM aged)
SELECT domain, source_type, count(*) AS n, count(*) FILTER (publication_date = '') AS any_missing, count(*) FILTER (trim(text) = '') AS empty_text, count(*) FILTER (score >= 0.66) AS high, count(*) FILTER (score >= 0.33 AND score < 0.66) AS medium, count(*) FILTER (score < 0.33) AS low, greatest(0, 120 - count(*)) AS shortfall FROM s GROUP BY ALL""")
def q138(spark, d):
    """Counts by domain, type and label; one count a record with any field missing; what is short of 120."""
    return quality.validation_report(corpus(spark, d), AS_OF, 120)


@query("q179_existence_checks", f"WITH {BUILT_SQL}, n AS (SELECT condition_id, count(*) AS n FROM built GROUP BY ALL) SELECT c.condition_id, n.n IS NOT NULL AS found, coalesce(n.n, -1) AS rows FROM conditions c LEFT JOIN n ON c.condition_id = n.condition_id")
def q179(spark, d):
    return experiment.existence(conditions(spark), cond.build_conditions(corpus(spark, d), AS_OF, 100), "condition_id")
