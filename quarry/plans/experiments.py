"""Queries over joins, retrieval and response metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text, vectors
from quarry.operators import evaluation as ev
from quarry.operators import experiment as ex
from quarry.operators import retrieval as rt
from quarry.plans.registry import query
from quarry.plans.texts import ALL_CLAIMS_SQL, CLAIMS_SQL, STEM_SQL
from quarry.schema import CORPUS_SQL, QA_SQL, corpus, qa, table

#: The stated query set of searches: ids divisible by 20, against all rows.
TOP_SQL = """scored AS (SELECT q.vec_id AS query_id, q.label AS ql, e.vec_id, e.label, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
top AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id))::INT AS rank FROM scored QUALIFY rank <= 5)"""
#: Labels in order of rank, with the metrics of each query.
PER_QUERY_SQL = TOP_SQL + """, lab AS (SELECT query_id, ql, list((label = ql)::INT ORDER BY rank) AS ls, list(label ORDER BY rank) AS labels, avg(similarity) AS sim FROM top GROUP BY ALL),
per AS (SELECT *, round(list_sum(ls)::DOUBLE / len(ls), 6) AS p5,
  round(coalesce(list_sum(list_transform(ls, lambda x, i: x / log2(i + 1))) / nullif(list_sum(list_transform(list_reverse_sort(ls), lambda x, i: x / log2(i + 1))), 0), 0), 6) AS ndcg FROM lab)"""


def _top(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return rt.top_k(e, asked, 5, "vec_id", "embedding", "query_id", "q")


def _per_query(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    top = _top(spark, d).join(e, "vec_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    seen = F.sort_array(F.collect_list(F.struct("rank", (F.col("label") == F.col("ql")).cast("int").alias("rel"), "label")))
    lists = top.groupBy("query_id", "ql").agg(seen.alias("x"), F.avg("similarity").alias("sim"))
    return lists.select("query_id", "ql", "sim", F.col("x.rel").alias("ls"), F.col("x.label").alias("labels"))


@query("q101_top_k", f"WITH {TOP_SQL} SELECT query_id, rank, vec_id, similarity FROM top")
def q101(spark, d):
    """Nested-loop top five #79, #101, cosine #105, top-k limit #91."""
    return _top(spark, d)


@query("q099_normalize", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings) SELECT vec_id, round(v[1] / n, 6) AS first, round(list_sum(v) / n, 6) AS total, round(list_max(v) / n, 6) AS most FROM e")
def q099(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", vectors.normalize(F.col("embedding")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(total, 6).alias("total"), F.round(F.array_max("v"), 6).alias("most"))


@query("q108_per_query_metrics", f"WITH {PER_QUERY_SQL} SELECT query_id, p5, ndcg, round(sim, 6) AS sim, CASE WHEN sim >= 0.7 THEN 'HIGH' WHEN sim >= 0.5 THEN 'MODERATE' ELSE 'LOW' END AS band FROM per")
def q108(spark, d):
    """Precision #108, nDCG #109, wrappers #184, alignment bands #106."""
    c = F.col
    return _per_query(spark, d).select("query_id", vectors.precision(c("ls"), 5).alias("p5"), vectors.ndcg(c("ls"), 5).alias("ndcg"), F.round("sim", 6).alias("sim"), rt.alignment(c("sim")).alias("band"))


@query("q110_retrieval_quality", f"WITH {PER_QUERY_SQL} SELECT ql AS label, {rt.six_sql('avg(p5)')} AS p5_mean, {rt.six_sql('coalesce(stddev_samp(p5), 0)')} AS p5_std, count(p5) AS p5_n, {rt.six_sql('avg(ndcg)')} AS ndcg_mean, {rt.six_sql('coalesce(stddev_samp(ndcg), 0)')} AS ndcg_std, count(ndcg) AS ndcg_n FROM per GROUP BY ql")
def q110(spark, d):
    """Retrieval quality by class: #110 and the condition tree #121 over one groupBy."""
    c = F.col
    per = _per_query(spark, d).select(c("ql").alias("label"), vectors.precision(c("ls"), 5).alias("p5"), vectors.ndcg(c("ls"), 5).alias("ndcg"))
    return per.groupBy("label").agg(*rt.stats(c("p5"), "p5"), *rt.stats(c("ndcg"), "ndcg"))


@query("q103_source_diversity", f"WITH {CORPUS_SQL}, n AS (SELECT domain, source_name, count(*) AS n FROM corpus GROUP BY ALL), s AS (SELECT domain, n / sum(n) OVER (PARTITION BY domain) AS p FROM n) SELECT domain, round(-sum(p * log2(p)), 6) AS sdi FROM s GROUP BY domain")
def q103(spark, d):
    return ex.diversity_index(corpus(spark, d), ["domain"], "source_name")


@query("q102_relevance_labels", f"WITH {CORPUS_SQL} SELECT seq, (contains(lower(title || ' ' || text), 'license') OR contains(lower(title || ' ' || text), 'tion the'))::INT AS label, 1 AS none FROM corpus")
def q102(spark, d):
    c = F.col
    return corpus(spark, d).select("seq", rt.relevance_label(c("title"), c("text"), F.array(F.lit("LICENSE"), F.lit("tion the"))).alias("label"), rt.relevance_label(c("title"), c("text"), F.array().cast("array<string>")).alias("none"))


@query("q078_pending", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def q078(spark, d):
    c = table(spark, d, "conversations")
    return rt.pending(c.where("role = 'user'").select("conv_id", "turn"), c.where("role = 'system'"), "conv_id")


@query("q077_verify_outputs", "SELECT d.doc_id, l.doc_id IS NOT NULL AS found FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def q077(spark, d):
    return rt.verify_outputs(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("q111_rouge_l", None)
def q111(spark, d):
    """Overlap of whole texts, in Arrow batches; tests hold it against the expression form."""
    return ev.rouge_l_batches(qa(spark, d), "response", "reference").select("conv_id", "turn", "rouge_l")


METEOR_SQL = f"""tok AS (SELECT conv_id, turn, list_transform(list_filter(list_filter(regexp_split_to_array(lower(response), '\\s+'), lambda t: t <> ''), lambda t: NOT list_contains({text.STOP_WORDS!r}, t)), lambda t: regexp_replace(t, '[.,!?;:"'']+$', '')) AS h0,
  list_transform(list_filter(list_filter(regexp_split_to_array(lower(reference), '\\s+'), lambda t: t <> ''), lambda t: NOT list_contains({text.STOP_WORDS!r}, t)), lambda t: regexp_replace(t, '[.,!?;:"'']+$', '')) AS r0 FROM qa),
st AS (SELECT conv_id, turn, list_transform(h0, lambda w: {STEM_SQL}) AS h, list_transform(r0, lambda w: {STEM_SQL}) AS r FROM tok),
mt AS (SELECT *, list_transform(h, lambda t: list_contains(r, t)::INT) AS hit FROM st),
cn AS (SELECT *, list_sum(hit)::DOUBLE AS m, 1 + list_sum(list_transform(hit, lambda x, i: x * (CASE WHEN i = 1 THEN 1 ELSE 1 - hit[i - 1] END)))::DOUBLE AS chunks FROM mt)"""


@query("q112_meteor", f"WITH {QA_SQL}, {METEOR_SQL} SELECT conv_id, turn, round(CASE WHEN coalesce(m, 0) = 0 OR len(r) = 0 THEN 0 ELSE greatest(0, (m / len(h)) * (m / len(r)) / (0.9 * (m / len(h)) + 0.1 * (m / len(r)) + 1e-9) * (1 - 0.5 * pow(chunks / m, 3))) END, 6) AS meteor FROM cn")
def q112(spark, d):
    return ev.meteor_batches(qa(spark, d), "response", "reference").select("conv_id", "turn", "meteor")


@query("q113_rescaled_cosine", f"WITH {TOP_SQL} SELECT query_id, rank, round((greatest(-1, least(1, similarity)) + 1) / 2, 6) AS score FROM top")
def q113(spark, d):
    return _top(spark, d).select("query_id", "rank", ev.rescaled_cosine(F.col("similarity")).alias("score"))


CW = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z]{{4,}}$')))"


def _hallucination_sql(claims: str, p1: str, p2: str) -> str:
    return f"""WITH {QA_SQL}, c AS (SELECT *, {claims.format('response')} AS cs FROM qa),
u AS (SELECT conv_id, turn, unnest(cs) AS claim, {p1} AS p1, {p2} AS p2 FROM c),
w AS (SELECT *, {CW.format('claim')} AS cw, {CW.format('p1')} AS w1, {CW.format('p2')} AS w2 FROM u),
s AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER (NOT (len(cw) = 0 OR len(list_intersect(cw, w1)) / len(cw) >= 0.4 OR len(list_intersect(cw, w2)) / len(cw) >= 0.4)) AS bad FROM w GROUP BY ALL)
SELECT c.conv_id, c.turn, round(coalesce(bad / n, 0), 6) AS rate FROM c LEFT JOIN s ON c.conv_id = s.conv_id AND c.turn = s.turn"""


#: Of whole texts: all claims, against whole passages.
HALLUCINATION_SQL = _hallucination_sql(ALL_CLAIMS_SQL, "reference", "question")


@query("q114_hallucination", _hallucination_sql(CLAIMS_SQL, "substr(reference, 1, 800)", "substr(question, 1, 800)"))
def q114(spark, d):
    """Claims against passages: #114 with the word rule #116; the first ten claims against a passage's first 800 characters."""
    return qa(spark, d).select("conv_id", "turn", ev.hallucination_rate(F.col("response"), F.array("reference", "question"), most=10, chars=800).alias("rate"))


@query("q117_attribution", f"WITH {QA_SQL} SELECT conv_id, turn, round((contains(lower(response), 'the')::INT + contains(lower(response), lower(substr(question, 1, 3)))::INT + contains(lower(response), lower(substr(reference, 1, 2)))::INT) / 4, 6) AS share FROM qa")
def q117(spark, d):
    return qa(spark, d).select("conv_id", "turn", ev.source_attribution(F.col("response"), F.array(F.lit("THE"), F.substring("question", 1, 3), F.substring("reference", 1, 2), F.lit(""))).alias("share"))


@query("q118_kappa", "SELECT n, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM (SELECT count(*) AS n, avg((quality = toxic)::INT) AS po, avg((quality = 0)::INT) * avg((toxic = 0)::INT) + avg((quality = 1)::INT) * avg((toxic = 1)::INT) AS pe FROM labels)")
def q118(spark, d):
    return ev.cohen_kappa(table(spark, d, "labels"), "quality", "toxic", [0, 1])


@query("q119_kappa_pooled", """WITH r AS (SELECT doc_id % 3 AS crit, 1 + doc_id % 5 AS a, 1 + (doc_id + quality) % 5 AS b, ((1 + doc_id % 5) + (1 + (doc_id + quality) % 5)) / 2.0 AS s FROM labels),
j AS (SELECT *, greatest(1, least(5, round_even(s, 0)::INT)) AS adj FROM r), p AS (SELECT crit, a AS x, adj FROM j UNION ALL SELECT crit, b, adj FROM j),
k AS (SELECT crit, count(*) AS n, avg((x = adj)::INT) AS po, """ + " + ".join(f"avg((x = {v})::INT) * avg((adj = {v})::INT)" for v in range(1, 6)) + """ AS pe FROM p GROUP BY crit)
SELECT crit, n, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM k""")
def q119(spark, d):
    """Raters pooled against their adjudicated score, by criterion."""
    n = F.col("doc_id")
    a, b = n % 5 + 1, (n + F.col("quality")) % 5 + 1
    rows = table(spark, d, "labels").select((n % 3).alias("crit"), a.alias("a"), b.alias("b"), ev.adjudicated((a + b) / 2).alias("adj"))
    both = rows.select("crit", F.col("a").alias("x"), "adj").union(rows.select("crit", "b", "adj"))
    return ev.cohen_kappa(both, "x", "adj", [1, 2, 3, 4, 5], ["crit"])


@query("q025_metric_write_back", "SELECT d.doc_id, coalesce(l.quality, length(d.text) % 2)::INT AS metric FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q025(spark, d):
    """A metric is added only where none is yet."""
    rows = table(spark, d, "documents").select("doc_id", (F.char_length("text") % 2).alias("fresh")).join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("metric")), "doc_id", "left")
    return ex.write_back(rows.select("doc_id", "metric"), rows.select("doc_id", F.col("fresh").alias("metric")), ["doc_id"], ["metric"]).select("doc_id", F.col("metric").cast("int").alias("metric"))


@query("q081_bank_by_domain", f"WITH {CORPUS_SQL}, b AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'technology' WHEN 1 THEN 'healthcare' ELSE 'history' END AS domain FROM benchmark) SELECT domain, count(*) AS pairs FROM corpus JOIN b USING (domain) GROUP BY domain")
def q081(spark, d):
    """Each domain's query bank meets its records; counted by key before the join, so no pair is made."""
    b = table(spark, d, "benchmark").select(F.when(F.col("item_id") % 3 == 0, "technology").when(F.col("item_id") % 3 == 1, "healthcare").otherwise("history").alias("domain"))
    left, right = corpus(spark, d).groupBy("domain").agg(F.count("*").alias("n")), b.groupBy("domain").agg(F.count("*").alias("m"))
    return left.join(right, "domain").select("domain", (F.col("n") * F.col("m")).alias("pairs"))


@query("q140_costs", "SELECT role, sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS tokens, round(sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) * 0.65 / 1e6, 9) AS cost FROM conversations GROUP BY role")
def q140(spark, d):
    """Tokens and cost by role at a price per million."""
    n = F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).cast("decimal(38,0)")
    return table(spark, d, "conversations").groupBy("role").agg(n.alias("tokens"), F.round(n.cast("double") * 0.65 / 1e6, 9).alias("cost"))


@query("q193_latency_harness", "SELECT arg_min(event_type, (m, event_type)) AS winner, round(min(m), 6) AS mean FROM (SELECT event_type, avg(value) AS m FROM events GROUP BY 1)")
def q193(spark, d):
    return ex.fastest(table(spark, d, "events"), "event_type", "value")
