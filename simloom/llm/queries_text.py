"""Registered queries of the operators that work on texts in Python tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm import html_text, jaccard, lm, quality, tokens, toxicity
from simloom.llm.columns import remainder
from simloom.llm.registry import query, table
from simloom.session import scratch_path

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op4_ngram_jaccard", sql=rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) AS g
  FROM t WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON r.c = e.a)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT d AS doc_id, min(c) AS component_id FROM r GROUP BY d) USING (doc_id)
""")
def op4_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    marks = jaccard.near_duplicates(table(spark, sf, "documents"), size=4, threshold=(85, 100))
    return marks.select("doc_id", "n_shingles", "component_id")


@query("op3_lm_score", sql=rf"""
WITH RECURSIVE bits AS (SELECT i AS b, i AS v, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT b, xor(v >> 1, 3988292384 * (v & 1)), step + 1 FROM bits WHERE step < 8
), crc AS (SELECT list(v ORDER BY b) AS table_ FROM bits WHERE step = 8
), d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, x: xor(a >> 8, table_[(xor(a, x) & 255) + 1]))) % 7 = 2 AS held_out
  FROM documents, crc
), t AS (
  SELECT doc_id, held_out, unnest(w || ['']) AS x, unnest(range(len(w) + 1)) AS i FROM d
), b AS (SELECT *, lag(x, 1, ' ') OVER (PARTITION BY doc_id ORDER BY i) AS h, lag(x, 2, ' ') OVER (PARTITION BY doc_id ORDER BY i) AS g FROM t
), u AS (SELECT x, count(*)::DOUBLE AS c FROM t WHERE NOT held_out GROUP BY x
), bi AS (SELECT h, x, count(*)::DOUBLE AS c FROM b WHERE NOT held_out GROUP BY h, x
), tri AS (SELECT g, h, x, count(*)::DOUBLE AS c FROM b WHERE NOT held_out AND i > 0 GROUP BY g, h, x
), h1 AS (SELECT h, sum(c) AS c FROM bi GROUP BY h
), h2 AS (SELECT g, h, sum(c) AS c FROM tri GROUP BY g, h
), s AS (SELECT sum(c) AS n, count(*)::DOUBLE AS v FROM u
), p AS (
  SELECT doc_id, held_out, coalesce(u.c, 0) AS cu, n, v, CASE WHEN u.c > 0 THEN (u.c - 0.75) / n ELSE 0.75 * v / n END AS p1,
         CASE WHEN h1.c IS NULL THEN 1 ELSE 0.75 * h1.c ** -0.3 END AS e1, coalesce(bi.c / h1.c, 0) AS f1,
         CASE WHEN h2.c IS NULL THEN 1 ELSE 0.75 * h2.c ** -0.3 END AS e2, coalesce(tri.c / h2.c, 0) AS f2
  FROM b CROSS JOIN s LEFT JOIN u USING (x) LEFT JOIN h1 USING (h) LEFT JOIN bi USING (h, x)
  LEFT JOIN h2 ON h2.g = b.g AND h2.h = b.h AND b.i > 0 LEFT JOIN tri ON tri.g = b.g AND tri.h = b.h AND tri.x = b.x AND b.i > 0
)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE cu > 0) AS n_known, max(n)::BIGINT AS train_tokens,
       sum(log10((cu + 1) / (n + v + 1))) AS base_score, sum(log10((1 - e2) * f2 + e2 * ((1 - e1) * f1 + e1 * p1))) AS score
FROM p GROUP BY doc_id, held_out
""")
def op3_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    held = remainder(F.col("doc_id"), 7) == 2
    out = lm.score(table(spark, sf, "documents"), ~held, order=3)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op8_token_ids")
def op8_token_ids(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return token_digests(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def token_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    out = tokens.encode(docs, tokenizer, scratch_path(docs.sparkSession, "shards"))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op5_html_text")
def op5_html_text(spark: SparkSession, sf: str) -> DataFrame:
    out = html_text.extract(table(spark, sf, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    learn = remainder(F.col("doc_id"), 3) != 1
    out = toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels"), learn)
    return out.select("doc_id", (~learn).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf: str) -> DataFrame:
    learn = remainder(F.col("doc_id"), 3) != 1
    out = quality.score(table(spark, sf, "documents"), table(spark, sf, "labels"), learn)
    return out.select("doc_id", (~learn).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
