"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._common import table
from quarry.llm.bm25 import bm25_topk
from quarry.llm.bpe import bpe_digests
from quarry.llm.exact_dedup import exact_dedup
from quarry.llm.langid import identify, train, training_rows
from quarry.llm.line_dedup import line_dedup
from quarry.llm.maxent import lm_scores
from quarry.llm.mixing import mix
from quarry.llm.negatives import hard_negatives
from quarry.llm.simhash import simhash_groups
from quarry.llm.substring_dedup import substring_dedup
from quarry.llm.threshold import threshold_topk
from quarry.llm.token_files import token_files_roundtrip
from quarry.llm.warc import warc_roundtrip


def op1_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20 asks, as a whole, for its ten best among all documents."""
    docs = table(spark, sf_dir, "documents")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return bm25_topk(docs, asked, k=10, k1=1.2, b=0.75)


OP1_SQL = r"""
WITH tok AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x20\x09-\x0D]+')) AS t FROM documents
), tf AS (SELECT doc_id, t, count(*) AS n FROM tok GROUP BY ALL
), len AS (SELECT doc_id, sum(n) AS dl FROM tf GROUP BY doc_id
), stat AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(dl) FROM len)::DOUBLE / (SELECT count(*) FROM documents) AS avgdl
), df AS (SELECT t, count(*)::DOUBLE AS df FROM tf GROUP BY t
), pair AS (
  SELECT q.doc_id AS query_id, d.doc_id,
         round(sum(q.n * ln(1 + (stat.n - df.df + 0.5) / (df.df + 0.5))
                   * (d.n * 2.2::DOUBLE / (d.n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len.dl / stat.avgdl)))), 6) AS score
  FROM tf q JOIN tf d ON q.t = d.t JOIN df ON q.t = df.t JOIN len ON len.doc_id = d.doc_id, stat
  WHERE q.doc_id % 20 = 0 GROUP BY ALL
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM pair QUALIFY rank <= 10
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH doc AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), line AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM doc
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line
), hit AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.line, l.pos, h.k IS NOT NULL AND l.doc_id <> h.keeper AS gone
  FROM keyed l LEFT JOIN hit h ON l.k = h.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""



def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_roundtrip(table(spark, sf_dir, "pages"))


# DuckDB has SHA-1 as hexadecimal text only; base32 takes its bits by five
OP3_SQL = r"""
WITH page AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages
), grp AS (SELECT h, max(page_id) AS keep FROM page GROUP BY h
), digits AS (
  SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(h, 10 * k + 1, 10))::BIGINT >> (35 - 5 * j)) & 31)::INT + 1, 1), '' ORDER BY k, j) AS b32
  FROM grp, (SELECT unnest(range(4)) AS k), (SELECT unnest(range(8)) AS j) GROUP BY h
)
SELECT p.page_id, octet_length(p.b)::BIGINT AS payload_bytes, d.b32 AS payload_digest,
       CASE WHEN p.page_id = g.keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> g.keep THEN g.keep END AS refers_to
FROM page p JOIN grp g ON p.h = g.h JOIN digits d ON p.h = d.h
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3)
    return done.select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH doc AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM doc GROUP BY source
), run AS (
  SELECT *, 3 * source_size AS top,
         coalesce(sum(3 * source_size) OVER r, 0)::BIGINT AS spent, coalesce(sum(w) OVER r, 0)::BIGINT AS used,
         (sum(source_size) OVER ())::BIGINT AS total, (sum(w) OVER ())::BIGINT AS weight
  FROM src
  WINDOW r AS (ORDER BY (3 * source_size)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lev AS (
  SELECT *, (total - spent)::DOUBLE / (weight - used)::DOUBLE AS level FROM run
), target AS (
  SELECT source, source_size, least(top::DOUBLE, coalesce(
           (SELECT level FROM lev WHERE level * w <= top ORDER BY top::DOUBLE / w, level LIMIT 1) * w, top::DOUBLE)) AS target
  FROM lev
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
         (row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id))::DOUBLE AS place,
         ('0x' || substr(md5('mix:' || coalesce(d.source, chr(0))), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM doc d JOIN target t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       size * least(floor(place * rate + u)::BIGINT - floor((place - 1) * rate + u)::BIGINT, 3) AS taken
FROM placed
"""


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = identify(docs, train(docs))
    return done.select("doc_id", (~training_rows(done, "doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = exact_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP6_SQL = """
WITH g AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM documents GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(g.t) AS text_sha256
FROM documents d JOIN g ON coalesce(d.text, '') = g.t
"""


def op7_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return bpe_digests(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), width=3, radius=2, seed=42)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=50).drop("kept")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), pos AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM pos
), first AS (
  SELECT h, min(doc_id) AS m FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)
), hit AS (
  SELECT doc_id, i FROM win JOIN first USING (h) WHERE doc_id > m
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit
), word AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def op11_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_topk(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


OP11_SQL = r"""
WITH tok AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents
), tf AS MATERIALIZED (SELECT doc_id, t, count(*)::BIGINT AS tf FROM tok GROUP BY ALL
), len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id
), stat AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM len
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), df AS (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t
), weight AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, stat
), m AS (SELECT doc_id, 50 + (50 * n * n_docs) // n_terms AS m FROM len, stat
), score AS (
  SELECT item_id, tf.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN weight USING (t) JOIN tf USING (t) JOIN m ON m.doc_id = tf.doc_id GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM score WHERE score > 0 QUALIFY rank <= 50
"""


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pair AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id))::INT AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM pos p JOIN pair n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return token_files_roundtrip(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))


QUERIES = {
    "op1_bm25": op1_bm25,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc": op3_warc,
    "op4_mixing": op4_mixing,
    "op5_langid": op5_langid,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_maxent": op7_maxent,
    "op8_bpe": op8_bpe,
    "op9_simhash": op9_simhash,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_threshold": op11_threshold,
    "op12_negatives": op12_negatives,
    "op13_token_files": op13_token_files,
}
#: The others need XXH64, tokenizers or models, which SQL doesn't have; tests hold them against brute force.
ORACLE_SQL = {"op1_bm25": OP1_SQL, "op2_line_dedup": OP2_SQL, "op3_warc": OP3_SQL, "op4_mixing": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op10_substring_dedup": OP10_SQL, "op11_threshold": OP11_SQL, "op12_negatives": OP12_SQL}
