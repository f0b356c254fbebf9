"""Projections, filters and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from simloom.functions import rects, strings
from simloom.operators import maintenance, predicates
from simloom.plans.catalogue import query, table
from simloom.plans.inputs import BOXES, boxes
from simloom.plans.maintenance import url_items

# Ids of the supplied pages: the url, every third with a region, every sixth with a label tag too.
_IDS = (
    "p AS (SELECT page_id, url || CASE WHEN page_id % 6 = 0 THEN E'\\tf{[1,2;3,4]\\td[tag' || page_id % 9 || ']}' "
    "WHEN page_id % 3 = 0 THEN E'\\tp[5,6;7,8]' WHEN page_id % 5 = 0 THEN E'\\td[tag5]' ELSE '' END AS id FROM pages), "
    "q AS (SELECT *, split_part(id, E'\\t', 1) AS path, nullif(regexp_extract(id, 'd\\[([^\\]]*)\\]', 1), '') AS tag FROM p)"
)


def ids(spark, sf):
    p = F.col("page_id")
    tail = (
        F.when(p % 6 == 0, F.concat(F.lit("\tf{[1,2;3,4]\td[tag"), p % 9, F.lit("]}")))
        .when(p % 3 == 0, F.lit("\tp[5,6;7,8]"))
        .when(p % 5 == 0, F.lit("\td[tag5]"))
        .otherwise("")
    )
    return table(spark, sf, "pages").select("page_id", F.concat("url", tail).alias("id"))


@query("derive_label",
       f"WITH {_IDS} SELECT page_id, coalesce(tag, nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), path) AS label FROM q")
def derive_label(spark, sf):
    return ids(spark, sf).select("page_id", strings.derive_label(F.col("id")).alias("label"))


@query("derive_paths",
       f"WITH {_IDS} SELECT page_id, path, regexp_extract(path, '^(.*)[/\\\\][^/\\\\]*$', 1) AS dir, regexp_extract(path, '([^/\\\\]*)$', 1) AS file, "
       "regexp_extract(regexp_extract(path, '([^/\\\\]*)$', 1), '\\.([^.]*)$', 1) AS ext FROM q")
def derive_paths(spark, sf):
    path = strings.file_path(F.col("id"))
    return ids(spark, sf).select(
        "page_id", path.alias("path"), strings.directory(path).alias("dir"), strings.file_name(path).alias("file"),
        strings.extension(path).alias("ext"),
    )


@query("derive_kind",
       f"WITH {_IDS} SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'f' WHEN page_id % 3 = 0 THEN 'p' ELSE 'w' END AS kind FROM q")
def derive_kind(spark, sf):
    return ids(spark, sf).select("page_id", strings.derive_kind(F.col("id")).alias("kind"))


@query("relabel",
       f"WITH {_IDS} SELECT page_id, coalesce(tag, CASE WHEN contains(path, '.') THEN nullif(split_part(path, '.', 1), '') END, path) AS label FROM q")
def relabel(spark, sf):
    return ids(spark, sf).select("page_id", strings.derive_label(F.col("id"), ".").alias("label"))


# Needles: 'www', 'blog' and language parts begin a part of a url; 'example' follows a dot.
@query("filter_infix",
       "WITH k(needle) AS (VALUES ('en/'), ('blog.'), ('example.net/de'), ('https'), ('xample')), "
       "h AS (SELECT needle, url AS item_id, length(url) - strpos(reverse(url), reverse(needle)) - length(needle) + 2 AS spot FROM pages, k WHERE contains(url, needle)) "
       "SELECT needle, item_id FROM h WHERE spot = 1 OR substr(item_id, spot - 1, 1) IN ('[', '/', '\\', '.')")
def filter_infix(spark, sf):
    needles = spark.createDataFrame([(n,) for n in ("en/", "blog.", "example.net/de", "https", "xample")], "needle string")
    return maintenance.matching(url_items(spark, sf), needles, exhaustive=True).select("needle", "item_id")


@query("list_items",
       "SELECT '' AS pattern, 'count' AS name, CAST(count(*) AS BIGINT) AS n FROM embeddings UNION ALL "
       "SELECT '*', CAST(vec_id AS VARCHAR), 1 FROM embeddings UNION ALL "
       "SELECT '@', CAST(label AS VARCHAR), count(*) FROM embeddings GROUP BY label UNION ALL "
       "SELECT 'count @', 'count', count(DISTINCT label) FROM embeddings UNION ALL "
       "SELECT '7', CAST(vec_id AS VARCHAR), 1 FROM embeddings WHERE vec_id = 7")
def list_items(spark, sf):
    x = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("item_id"), "label")
    out = None
    for p in ("", "*", "@", "count @", "7"):
        one = maintenance.list_items(x, p).select(F.lit(p).alias("pattern"), "name", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("filter_count_range",
       "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey) >= 3 AND "
       "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) <= 4")
def filter_count_range(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return predicates.keep_child_count(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], 3, 4)


@query("filter_region_size", f"WITH {BOXES} SELECT img, rid FROM b WHERE greatest(w, h) >= 20 AND least(w / h, h / w) >= 0.5")
def filter_region_size(spark, sf):
    return boxes(spark, sf).filter(predicates.size_ok(F.col("r"), 20, 0.5)).select("img", "rid")


@query("filter_eval_kinds",
       f"WITH {BOXES}, k AS (SELECT *, ['f', 'u', 's'][rid % 3 + 1] AS k FROM b) SELECT img, rid, array_to_string(list_filter(["
       "['i', 'e', 'n'][rid % 3 + 1], ['m', 'x', 'i', 'e'][rid % 4 + 1]], lambda t: t IN ('f', 'p', 'i', 'n', 'm')), ',') AS subs FROM k WHERE k = 'f'")
def filter_eval_kinds(spark, sf):
    def pick(values, n):
        return F.element_at(F.array(*map(F.lit, values)), (F.col("rid") % n + 1).cast("int"))

    subs = F.array(F.struct(pick("ien", 3).alias("kind")), F.struct(pick("mxie", 4).alias("kind")))
    regions = F.array(F.struct(pick("fus", 3).alias("kind"), subs.alias("subs")))
    df = boxes(spark, sf).select("img", "rid", F.explode(rects.keep_kinds(regions)).alias("k"))
    return df.select("img", "rid", F.array_join(F.transform("k.subs", lambda s: s["kind"]), ",").alias("subs"))


_URL = (
    "u AS (SELECT page_id, CASE WHEN page_id % 17 = 0 THEN '' ELSE 'key' || page_id % 5 END AS key, CASE WHEN page_id % 11 = 0 THEN -1 ELSE page_id % 40 END AS ev, "
    "CASE page_id % 13 WHEN 1 THEN NULL WHEN 2 THEN ' ' WHEN 3 THEN 'file:///x' WHEN 4 THEN replace(url, 'http', 'gopher') WHEN 5 THEN substr(url, 9) ELSE url END AS url FROM pages)"
)


@query("validate_request",
       f"WITH {_URL} SELECT page_id, CAST(CASE WHEN key = '' THEN 3 WHEN key = 'key4' THEN 2 WHEN ev = -1 THEN 4 WHEN url IS NULL THEN 8 WHEN trim(url) = '' THEN 7 "
       "WHEN NOT regexp_matches(url, '^(https?|ftp|file):') THEN 9 WHEN starts_with(url, 'file:') THEN 11 ELSE 0 END AS BIGINT) AS code FROM u")
def validate_request(spark, sf):
    p = F.col("page_id")
    df = table(spark, sf, "pages").select(
        "page_id",
        F.when(p % 17 == 0, "").otherwise(F.concat(F.lit("key"), p % 5)).alias("key"),
        F.when(p % 11 == 0, -1).otherwise(p % 40).alias("ev"),
        F.when(p % 13 == 1, None).when(p % 13 == 2, " ").when(p % 13 == 3, "file:///x")
        .when(p % 13 == 4, F.replace("url", F.lit("http"), F.lit("gopher")))
        .when(p % 13 == 5, F.substring("url", F.lit(9), F.length("url"))).otherwise(F.col("url")).alias("url"),
    )
    code = predicates.request_code(F.col("key"), F.col("key") != "key4", F.col("ev"), F.col("url"))
    return df.select("page_id", code.alias("code"))


def annotated(spark, sf):
    """Region lines from the boxes; some are broken on purpose."""
    i, r = F.col("rid"), F.col("r")
    x = r["x"] - F.when(i % 29 == 0, 500).otherwise(0)
    w = F.when(i % 31 == 0, 0).otherwise(r["w"])
    gap = F.when(i % 37 == 0, " ").otherwise("\t")
    nums = F.concat_ws(";", F.concat_ws(",", x, r["y"]), F.concat_ws(",", w, r["h"]))
    line = F.concat(F.lit("img"), F.col("img"), gap, F.lit("f["), nums, F.lit("]"))
    return boxes(spark, sf).select("img", "rid", line.alias("line"), rects.rect(x, r["y"], w, r["h"]).alias("r"))


@query("validate_regions",
       f"WITH {BOXES} SELECT img, rid, rid % 29 <> 0 AND rid % 31 <> 0 AND rid % 37 <> 0 AS ok FROM b")
def validate_regions(spark, sf):
    ok = predicates.regions_ok(F.col("line"), F.array("r"))
    return annotated(spark, sf).select("img", "rid", ok.alias("ok"))


# Documents with every fourth word group in brackets; the closing mark differs by id.
@query("validate_balance",
       "SELECT doc_id, doc_id % 5 NOT IN (1, 2, 3) AS ok FROM documents")
def validate_balance(spark, sf):
    t = F.regexp_replace("text", r"[{}\[\]]", " ")
    i = F.col("doc_id")
    tail = F.when(i % 5 == 1, "{").when(i % 5 == 2, "]").when(i % 5 == 3, "}").otherwise("")
    line = F.concat(F.lit("f{["), t, F.lit("]\td["), F.col("source"), F.lit("]"), F.when(i % 5 == 3, "").otherwise("}"), tail,
                    F.when(i % 5 == 3, "}").when(i % 5 == 1, "f{").when(i % 5 == 2, "g{x}").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", predicates.balanced(line).alias("ok"))


@query("validate_cardinality",
       f"WITH {BOXES}, k AS (SELECT img, rid, ['f', 'i', 'n', 'm', 'e', 'a', 'g'][rid % 7 + 1] AS kind FROM b) SELECT img, rid, kind FROM k WHERE img NOT IN "
       "(SELECT img FROM k GROUP BY img HAVING count(*) FILTER (WHERE kind IN ('f', 'p')) > 1 OR count(*) FILTER (WHERE kind IN ('i', 'n', 'e', 'm')) > 6 "
       "OR count(*) FILTER (WHERE kind = 'a') > 1 OR count(*) FILTER (WHERE kind = 'g') > 1)")
def validate_cardinality(spark, sf):
    kinds = F.element_at(F.array(*map(F.lit, "finmeag")), (F.col("rid") % 7 + 1).cast("int"))
    parts = boxes(spark, sf).select("img", "rid", kinds.alias("kind"))
    return predicates.within_limits(parts, "img", limits={"a": 1, "g": 1})


@query("validate_vocab",
       "WITH a AS (SELECT DISTINCT c_nationkey * 10 + c_custkey % 10 AS item_id, 'o' AS code, c_mktsegment AS value, c_custkey FROM customer), "
       "e AS (SELECT item_id, code, 'unknown value' AS problem FROM a WHERE value = 'MACHINERY' UNION "
       "SELECT item_id, code, 'too many' FROM a GROUP BY ALL HAVING count(*) > 7 UNION "
       "SELECT x.item_id, x.code, 'excluded pair' FROM a x JOIN a y USING (item_id) WHERE (x.value, y.value) IN (('BUILDING', 'FURNITURE'), ('HOUSEHOLD', 'AUTOMOBILE'))) "
       "SELECT * FROM e")
def validate_vocab(spark, sf):
    attrs = table(spark, sf, "customer").select(
        (F.col("c_nationkey") * 10 + F.col("c_custkey") % 10).alias("item_id"), F.lit("o").alias("code"), F.col("c_mktsegment").alias("value")
    )
    vocab = spark.createDataFrame([("o", v, 7) for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "AUTOMOBILE")], "code string, value string, max_n int")
    pairs = spark.createDataFrame([("o", "BUILDING", "FURNITURE"), ("o", "HOUSEHOLD", "AUTOMOBILE")], "code string, a string, b string")
    return predicates.vocabulary_errors(attrs, vocab, pairs)


@query("normalise_annotation",
       f"WITH {BOXES}, n AS (SELECT *, x || ',' || y || ';' || w || ',' || h AS g FROM b) SELECT img, rid, CAST(p AS BIGINT) AS pos, CASE WHEN p = 0 THEN 'f{{[' || g || E']\\td[img' || img || ']}}' "
       "WHEN p = 1 THEN 'p{[' || g || E']\\ti[1,1;2,2]\\td[img' || img || ']}' ELSE 'f{[' || g || E']\\td[own]}' END AS region_group FROM n, (SELECT unnest([0, 1, 2]) AS p) z WHERE p <= rid % 3".replace("{{", "{").replace("}}", "}"))
def normalise_annotation(spark, sf):
    r = F.col("r")
    g = F.concat_ws(";", F.concat_ws(",", r["x"], r["y"]), F.concat_ws(",", r["w"], r["h"]))
    parts = F.array(
        F.concat(F.lit("f["), g, F.lit("]")),
        F.concat(F.lit("p{["), g, F.lit("]\ti[1,1;2,2]}")),
        F.concat(F.lit("f{["), g, F.lit("]\td[own]}")),
    )
    some = F.slice(parts, F.lit(1), (F.col("rid") % 3 + 1).cast("int"))
    lines = boxes(spark, sf).select(
        F.struct("img", "rid").alias("key"), F.concat(F.lit("img"), F.col("img"), F.lit("\t"), F.array_join(some, "\t")).alias("line")
    )
    return predicates.normalise_annotations(lines, "key").select("key.img", "key.rid", "pos", "region_group")
