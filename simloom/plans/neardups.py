"""Near-duplicate documents by MinHash sketches, and exact duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from simloom.operators import neardup
from simloom.plans.catalogue import query, table
from simloom.plans.inputs import unit01
from simloom.session import cut

_SKETCH = (
    "[" + ", ".join(f"list_min(list_transform(w, lambda t: (t[1] + {i} * t[2]) % 4294967311))" for i in range(16)) + "]"
)


def _sketched(source: str, key: str, text: str, extra: str = "") -> str:
    """Rows (seq, sk) of a table: sketch of the distinct lower-cased words of a text."""
    return (
        f"SELECT seq, {_SKETCH} AS sk{extra} FROM (SELECT {key} AS seq, list_transform(list_distinct(list_filter("
        f"regexp_split_to_array(lower({text}), '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '')), lambda t: [CAST('0x' || substr(md5(t), 1, 8) AS BIGINT), CAST('0x' || substr(md5(t), 9, 8) AS BIGINT)]) AS w{extra} FROM {source}) "
        "WHERE len(w) > 0"
    )


DOCS = f"s AS MATERIALIZED ({_sketched('documents', 'doc_id', 'text', ', n_chars')})"
AGREE = "list_sum(list_transform(list_zip(a.sk, b.sk), lambda t: CASE WHEN t[1] = t[2] THEN 1 ELSE 0 END))"
_DIST = "CASE WHEN g = 16 THEN 0 ELSE round(" + unit01("-0.27 * g") + ", 6) END"
_LINK = (
    f", pr AS (SELECT a.seq AS i, b.seq AS j, {AGREE} AS g FROM s a JOIN s b ON b.seq < a.seq), "
    "k AS MATERIALIZED (SELECT i AS seq, j AS parent, " + _DIST + " AS dist FROM pr WHERE g >= 12 "
    "QUALIFY row_number() OVER (PARTITION BY i ORDER BY g DESC, j) = 1)"
)
_TREE = (
    ", up AS (SELECT seq, parent, parent AS top, 1 AS lv FROM k UNION ALL SELECT up.seq, up.parent, k.parent, lv + 1 "
    "FROM up JOIN k ON up.top = k.seq), gr AS (SELECT seq, min(top) AS grp FROM up GROUP BY seq), "
    "gm AS (SELECT seq, grp FROM gr UNION SELECT grp, grp FROM gr), "
    "ga AS (SELECT gm.seq, grp, n_chars AS area FROM gm JOIN s USING (seq)), "
    "rp AS (SELECT grp, first(seq ORDER BY area DESC, seq) AS rep FROM ga GROUP BY grp)"
)
LINKS = DOCS + _LINK
GROUPS = LINKS + _TREE


def sketched(df, key: str):
    return neardup.sketched(df, key).withColumnRenamed(key, "seq")


def docs(spark, sf):
    return sketched(table(spark, sf, "documents"), "doc_id")


def links(spark, sf):
    return neardup.link(docs(spark, sf))


def grouped(spark, sf):
    areas = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("n_chars").alias("area"))
    return neardup.with_groups(areas, links(spark, sf))


@query("neardup_link", f"WITH {LINKS} SELECT seq, parent, dist FROM k")
def neardup_link(spark, sf):
    return links(spark, sf)


@query("neardup_groups",
       f"WITH RECURSIVE {GROUPS} SELECT doc_id AS seq, coalesce(grp, 0) AS grp, grp IS NOT NULL AS linked FROM documents LEFT JOIN gm ON doc_id = seq")
def neardup_groups(spark, sf):
    return grouped(spark, sf).select(
        "seq", F.coalesce("grp", F.lit(0)).alias("grp"), F.col("grp").isNotNull().alias("linked")
    )


@query("neardup_representative", f"WITH RECURSIVE {GROUPS} SELECT grp, rep FROM rp")
def neardup_representative(spark, sf):
    return neardup.representatives(grouped(spark, sf))


@query("neardup_pairs",
       f"WITH RECURSIVE {GROUPS} SELECT seq, grp, CASE WHEN rep <> seq THEN rep END AS rep FROM ga JOIN rp USING (grp)")
def neardup_pairs(spark, sf):
    return neardup.pairs(grouped(spark, sf))


@query("dedup_unique",
       f"WITH RECURSIVE {GROUPS} SELECT doc_id AS seq FROM documents WHERE doc_id NOT IN (SELECT seq FROM ga JOIN rp USING (grp) WHERE seq <> rep)")
def dedup_unique(spark, sf):
    return neardup.unique(grouped(spark, sf)).select("seq")


# A benchmark text is a needle in longer documents, so the bar is lower than between documents.
@query("neardup_against",
       f"WITH {DOCS}, q AS ({_sketched('benchmark', 'item_id', 'text')}), pr AS (SELECT a.seq AS i, b.seq AS j, {AGREE} AS g FROM q a, s b) "
       f"SELECT i AS query_id, j AS item_id, {_DIST.replace('0.27', '0.8')} AS dist FROM pr WHERE g >= 4")
def neardup_against(spark, sf):
    q = sketched(table(spark, sf, "benchmark"), "item_id").withColumnRenamed("seq", "query_id")
    x = docs(spark, sf).withColumnRenamed("seq", "item_id")
    return neardup.against(q, x, scale=0.8)


@query("neardup_declared",
       f"WITH {DOCS}, dc AS (SELECT doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE doc_id // 2 END AS parent FROM documents UNION ALL "
       "SELECT doc_id, first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE first < doc_id), "
       f"pr AS (SELECT dc.seq, dc.parent, a.sk IS NULL OR b.sk IS NULL AS lost, {AGREE} AS g FROM dc LEFT JOIN s a ON a.seq = dc.seq LEFT JOIN s b ON b.seq = dc.parent) "
       "SELECT seq, parent, CASE WHEN seq = parent THEN 'self' WHEN lost THEN 'unknown' WHEN g >= 12 THEN 'ok' ELSE 'rejected' END AS verdict FROM pr")
def neardup_declared(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", "text")
    i = F.col("doc_id")
    guesses = t.select(i.alias("seq"), F.when(i % 3 == 0, i).otherwise(F.floor(i / 2)).alias("parent"))
    first = t.groupBy("text").agg(F.min("doc_id").alias("parent"))
    copies = t.join(first, "text").filter("parent < doc_id").select(i.alias("seq"), "parent")
    return neardup.check_declared(guesses.unionByName(copies), docs(spark, sf))


# Variants of a document: the whole, and the text without its first 40 or its last 40 characters.
_PROBES = " UNION ALL ".join(
    f"({_sketched('documents', 'doc_id', t)})"
    for t in ("text", "substr(text, 41)", "substr(text, 1, greatest(length(text) - 40, 0))")
)


@query("neardup_phases",
       f"WITH {DOCS}, v AS MATERIALIZED ({_PROBES}), pr AS (SELECT a.seq AS i, b.seq AS j, {AGREE} AS g FROM v a JOIN s b ON b.seq < a.seq) "
       f"SELECT i AS seq, j AS parent, {_DIST} AS dist FROM pr WHERE g >= 12 QUALIFY row_number() OVER (PARTITION BY i ORDER BY g DESC, j) = 1")
def neardup_phases(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", "text")
    text = F.col("text")
    tail = F.substring(text, F.lit(41), F.length(text))
    head = F.substring(text, F.lit(1), F.greatest(F.length(text) - 40, F.lit(0)))
    variants = t.select("doc_id", F.posexplode(F.array(text, tail, head)).alias("variant", "text"))
    probes = neardup.sketched(variants, "doc_id", "variant").select(F.col("doc_id").alias("seq"), "sketch")
    return neardup.link_probes(probes, docs(spark, sf))


# Synthetic copies under ids after all others: one extra blank word, one word less.
_SYN = _sketched(
    "(SELECT doc_id * 2 + 1 AS doc_id, regexp_replace(text, '^[^ ]+ ', '') AS text FROM documents UNION ALL SELECT doc_id * 2, text FROM documents)",
    "doc_id", "text")


@query("neardup_synthetic",
       f"WITH RECURSIVE s AS MATERIALIZED ({_SYN})" + _LINK + _TREE.replace("n_chars AS area", "1 AS area") +
       " SELECT a.seq // 2 AS doc_id, a.grp IS NOT NULL AND a.grp = b.grp AS together FROM (SELECT s.seq, grp FROM s LEFT JOIN gm USING (seq)) a "
       "JOIN (SELECT s.seq, grp FROM s LEFT JOIN gm USING (seq)) b ON b.seq = a.seq - 1 WHERE a.seq % 2 = 1")
def neardup_synthetic(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", "text")
    i = F.col("doc_id")
    copies = t.select((i * 2 + 1).alias("doc_id"), F.regexp_replace("text", "^[^ ]+ ", "").alias("text"))
    both = cut(sketched(copies.unionByName(t.select((i * 2).alias("doc_id"), "text")), "doc_id"))
    live = neardup.with_groups(both.select("seq"), neardup.link(both))
    source = live.select((F.col("seq") + 1).alias("seq"), F.col("grp").alias("source_grp"))
    return live.filter("seq % 2 = 1").join(source, "seq").select(
        F.floor(F.col("seq") / 2).alias("doc_id"),
        F.coalesce(F.col("grp") == F.col("source_grp"), F.lit(False)).alias("together"),
    )


@query("exact_dups",
       "SELECT sha256(text) AS digest, min(doc_id) AS first, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dups(spark, sf):
    return neardup.exact_groups(table(spark, sf, "documents"), "text", "doc_id")
