"""Registered queries of the native operators, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm import chat, decontaminate, exact_dedup, mixing
from simloom.llm.registry import query, table

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op2_chat_rotation", sql="""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS who, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations
), people AS (SELECT DISTINCT conv_id AS c, who AS perspective FROM t WHERE who NOT IN ('', 'system')),
pieces AS (
  SELECT conv_id, perspective, (n - 1) // 512 AS part, n, who = perspective AS own,
         '<|' || CASE WHEN who = perspective THEN 'assistant' WHEN who IN ('', 'system') THEN 'system'
                      ELSE 'user name=' || who END || '|>' || chr(10) AS head,
         text || '<|end|>' || chr(10) AS body
  FROM t JOIN people ON conv_id IS NOT DISTINCT FROM c
)
SELECT conv_id, perspective, part, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_trained,
       string_agg(head || body, '' ORDER BY n) AS rendered,
       string_agg(length(head) || ',0;' || length(body) || ',' || own::INT, ';' ORDER BY n) AS mask
FROM pieces GROUP BY conv_id, perspective, part
""")
def op2_chat_rotation(spark: SparkSession, sf: str) -> DataFrame:
    out = chat.rotate(table(spark, sf, "conversations"))
    mask = F.array_join(F.transform("spans", lambda s: F.concat_ws(",", s["chars"], s["train"].cast("int"))), ";")
    return out.withColumn("mask", mask).drop("spans")


@query("op6_decontaminate", sql=rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex({LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id::VARCHAR AS i, list_filter(string_split_regex({LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), windows AS (
  SELECT i, len(w) AS n, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda s: array_to_string(w[s:s + 12], ' '))) AS win
  FROM b WHERE len(w) > 0
), sizes AS (SELECT DISTINCT least(n, 13) AS k FROM windows),
win AS (SELECT DISTINCT i, least(n, 13) AS k, win FROM windows),
starts AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS s, w FROM d JOIN sizes ON len(w) >= k
), found AS (
  SELECT DISTINCT doc_id, s, win.k, i FROM starts JOIN win ON win.k = starts.k AND win = array_to_string(w[s:s + starts.k - 1], ' ')
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT i) AS n_items, string_agg(DISTINCT i, ',' ORDER BY i) AS l FROM found GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op6_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return out.select(
        "doc.doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


@query("op7_mix_sources", sql=r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix' || doc_id::VARCHAR) AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS sid FROM d GROUP BY source
), w AS (
  SELECT *, [3.0, 1.0, 2.0][(sid - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2::DOUBLE AS cap FROM s
), l AS (
  SELECT *, cap / weight AS ratio,
         (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - (sum(cap) OVER o - cap)) / ((SELECT sum(weight) FROM w) - (sum(weight) OVER o - weight)) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, sid ROWS UNBOUNDED PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, (SELECT max(level) FROM l WHERE level < ratio) * weight) AS target FROM l
), q AS (
  SELECT doc_id, u, size, p, (p * source_size + sum(size) OVER (PARTITION BY t.source, p ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING)) / target AS finish
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) AS passes(p) WHERE size > 0
), served AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, u, doc_id, p ROWS UNBOUNDED PRECEDING) AS spent FROM q
), k AS (
  SELECT doc_id, count(*) AS copies FROM served WHERE spent <= 1.5::DOUBLE * (SELECT sum(source_size) FROM s) GROUP BY doc_id
)
SELECT d.doc_id, d.size, t.source_size, t.target, (coalesce(k.copies, 0) * d.size)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN k USING (doc_id)
""")
def op7_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_exact_dedup", sql=r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS c, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
), g AS (
  SELECT doc_id, h, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size
  FROM t WINDOW w AS (PARTITION BY h ORDER BY c DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
""")
def op10_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf, "documents"))
