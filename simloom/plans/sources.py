"""Scans and sinks: every query writes derived rows to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from simloom.functions.scalars import rounded
from simloom.operators import similarity
from simloom.plans.catalogue import query, table
from simloom.plans.inputs import BOXES, E, as_queries, boxes, centroid_hits, centroids, items, neighbours
from simloom.plans.likelihood import _CUBE, cube, wide
from simloom.session import scratch_path
from simloom.sources import results, tables, text


def summary(df):
    total = F.aggregate("vec", F.lit(0.0), lambda a, t: a + t)
    return df.select("item_id", "label", F.size("vec").cast("bigint").alias("size"), rounded(total).alias("total"))


def typed(spark, sf):
    return items(spark, sf).withColumn("dtype", F.lit("dense"))


_SUMMARY = "SELECT id AS item_id, label, CAST(len(v) AS BIGINT) AS size, round(list_sum(v), 6) AS total FROM e"


@query("scan_items", f"WITH {E} {_SUMMARY}")
def scan_items(spark, sf):
    return summary(items(spark, sf))


@query("save_items", f"WITH {E}, s AS ({_SUMMARY}) SELECT f AS format, s.* FROM s, (SELECT unnest(['parquet', 'json', 'csv', 'orc']) AS f)")
def save_items(spark, sf):
    out = None
    for fmt in ("parquet", "json", "csv", "orc"):
        path = scratch_path(spark, "items") + f".{fmt}"
        tables.save_items(typed(spark, sf), path)
        one = summary(tables.load_items(spark, path)).withColumn("format", F.lit(fmt))
        out = one if out is None else out.unionByName(one)
    return out


def save_in_three(spark, sf):
    root = scratch_path(spark, "parts")
    paths = []
    for n in range(3):
        paths.append(f"{root}/part{n}.parquet")
        tables.save_items(typed(spark, sf).filter(F.pmod("label", F.lit(3)) == n), paths[-1])
    return root, paths


@query("scan_multi", f"WITH {E} {_SUMMARY}")
def scan_multi(spark, sf):
    root, paths = save_in_three(spark, sf)
    listing = spark.createDataFrame([(p,) for p in ["# tables", *paths, ""]], "value string")
    listing.coalesce(1).write.text(root + "/list")
    return summary(tables.load_listed(spark, root + "/list"))


@query("scan_per_item_files", f"WITH {E} {_SUMMARY}")
def scan_per_item_files(spark, sf):
    path = scratch_path(spark, "per-item")
    tables.save_per_item(typed(spark, sf), path, {"dense": 1.0}, buckets=8)
    return summary(tables.load_per_item(spark, path))


def write_lines(spark, df, name):
    path = scratch_path(spark, name)
    df.select("value").write.text(path)
    return path


@query("scan_ensemble_manifest",
       "SELECT p_type AS dtype, CASE WHEN p_partkey % 4 <> 0 THEN 'f' || p_partkey END AS file, CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE p_size / 10.0 END::DOUBLE AS weight, '~' AS delimiter "
       "FROM part WHERE p_partkey % 7 <> 0")
def scan_ensemble_manifest(spark, sf):
    k = F.col("p_partkey")
    line = F.concat_ws("\t", "p_type", F.when(k % 4 == 0, "NULL").otherwise(F.concat(F.lit("f"), k)),
                       F.when(k % 3 != 0, (F.col("p_size") / 10).cast("string")))
    lines = table(spark, sf, "part").select(
        F.when(k % 14 == 0, "# LabelDelimiter ~").when(k % 7 == 0, "# note").otherwise(line).alias("value")
    )
    read = spark.read.text(write_lines(spark, lines, "manifest")).withColumnRenamed("value", "line")
    return text.parse_manifest(read).withColumn("delimiter", F.lit(text.manifest_delimiter(read)))


@query("scan_list_text",
       "SELECT 'conv' || conv_id || '.' || turn AS file, CAST(length(role) + 1 + length('conv' || conv_id || '.' || turn) AS BIGINT) AS size FROM conversations WHERE turn % 4 < 2")
def scan_list_text(spark, sf):
    t = F.col("turn")
    name = F.concat(F.lit("conv"), "conv_id", F.lit("."), "turn")
    line = F.when(t % 4 == 2, "# skipped").when(t % 4 == 3, "  ").otherwise(F.concat_ws("\t", name, "role"))
    lines = table(spark, sf, "conversations").select(line.alias("value"))
    return text.scan_list(spark, write_lines(spark, lines, "list")).select("file", F.length("line").cast("bigint").alias("size"))


@query("scan_region_text",
       f"WITH {BOXES} SELECT img, rid, CAST(n AS BIGINT) AS region_no, CASE WHEN n = 0 THEN 'f' ELSE 'p' END AS kind, rid % 13 <> 0 OR n = 1 AS ok, "
       "CASE WHEN rid % 13 <> 0 OR n = 1 THEN x END AS x, CASE WHEN rid % 13 <> 0 OR n = 1 THEN h END AS h, CAST(CASE WHEN n = 0 THEN 1 ELSE 0 END AS BIGINT) AS subs, "
       "CASE WHEN n = 0 THEN 'tag' || rid % 5 END AS tag FROM b, (SELECT unnest([0, 1]) AS n)")
def scan_region_text(spark, sf):
    r, i = F.col("r"), F.col("rid")

    def nums(first):
        return F.concat(F.lit("["), first, F.lit(","), r["y"], F.lit(";"), r["w"], F.lit(","), r["h"], F.lit("]"))

    line = F.concat(
        F.lit("file"), F.col("img"), F.lit("."), i, F.lit("\tf{"), nums(F.when(i % 13 == 0, "?").otherwise(r["x"].cast("string"))),
        F.lit("\ti[1,2;3,4]\td[tag"), i % 5, F.lit("]}\tp"), nums(r["x"].cast("string")),
    )
    lines = boxes(spark, sf).select(line.alias("value"))
    read = text.scan_list(spark, write_lines(spark, lines, "regions"))
    got = text.parse_regions(read)
    ids = F.split("file", r"\.")
    big = lambda c: c.cast("bigint")
    return got.select(
        big(F.substring(ids[0], 5, 20)).alias("img"), big(ids[1]).alias("rid"), big(F.col("region_no")).alias("region_no"), "kind", "ok",
        big(F.col("r.x")).alias("x"), big(F.col("r.h")).alias("h"), big(F.size("subs")).alias("subs"),
        F.try_element_at("attrs", F.lit(1))["value"].alias("tag"),
    )


@query("scan_keyvalue_gt",
       "SELECT o_orderkey AS capture, o_custkey AS subject, CASE WHEN c_custkey IS NULL THEN 'unknown' WHEN year(o_orderdate) - (1950 + c_custkey % 60) < 20 THEN 'youth' ELSE 'adult' END AS age_group, c_mktsegment AS segment "
       "FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def scan_keyvalue_gt(spark, sf):
    c = table(spark, sf, "customer")
    pairs = F.explode(F.array(F.concat(F.lit("yob="), F.col("c_custkey") % 60 + 1950), F.concat(F.lit("segment = "), "c_mktsegment")))
    lines = c.select("c_custkey", pairs.alias("kv")).select(F.concat_ws("\t", "c_custkey", "kv").alias("value"))
    read = spark.read.text(write_lines(spark, lines, "subjects")).select(
        F.substring_index("value", "\t", 1).cast("bigint").alias("subject"), F.substring_index("value", "\t", -1).alias("line")
    )
    subjects = text.parse_key_values(read, ["yob", "segment"])
    captures = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("capture"), F.col("o_custkey").alias("subject"), F.year("o_orderdate").cast("string").alias("capture_year")
    )
    return text.age_group(captures, subjects).select("capture", "subject", "age_group", "segment")


@query("scan_csv_metadata",
       "SELECT s_suppkey || '_' || s_nationkey AS file, s_name || ', \"x\"' AS info FROM supplier")
def scan_csv_metadata(spark, sf):
    s = table(spark, sf, "supplier")
    path = scratch_path(spark, "meta")
    s.select(F.col("s_suppkey").cast("string").alias("id"), F.concat("s_name", F.lit(', "x"')).alias("info")).write.csv(
        path, header=True, quoteAll=True, escape='"')
    meta = text.scan_metadata(spark, path, "id string, info string")
    files = s.select(F.concat_ws("_", "s_suppkey", "s_nationkey").alias("file"))
    return text.attach_by_prefix(files, meta, "file", "id").select("file", "info")


@query("scan_histogram_xyzv", f"WITH {_CUBE} SELECT i, j, k, v / 8.0::DOUBLE AS v, 'Lab' AS color_space, CAST(8 AS BIGINT) AS bins FROM cb")
def scan_histogram_xyzv(spark, sf):
    cells = text.cube_lines(cube(spark, sf).withColumn("v", F.col("v") / 8))
    head = spark.createDataFrame([("# ColorSpace=Lab",), ("# BinCnt=8",)], "value string")
    read = spark.read.text(write_lines(spark, head.unionByName(cells), "cube")).withColumnRenamed("value", "line")
    space, bins = text.cube_directives(read)
    return wide(text.parse_cube(read)).select("*", F.lit(space).alias("color_space"), F.lit(bins).cast("bigint").alias("bins"))


@query("save_histogram_xyzv", f"WITH {_CUBE} SELECT i || E'\\t' || j || E'\\t' || k || E'\\t' || v AS line FROM cb WHERE v <> 0")
def save_histogram_xyzv(spark, sf):
    path = write_lines(spark, text.cube_lines(cube(spark, sf)), "cube")
    return spark.read.text(path).withColumnRenamed("value", "line")


def top_hits(spark, sf):
    x = items(spark, sf)
    return similarity.search(as_queries(x), x, top_n=5, skip="id")


_LINE = "format('{:.6f}', d) || E'\\t' || iid"


@query("results_text",
       f"WITH {neighbours(5)} SELECT qid AS query_id, qid || ' found ' || count(*) || E'\\n' || string_agg({_LINE}, E'\\n' ORDER BY r) AS doc FROM n GROUP BY qid")
def results_text(spark, sf):
    return results.results_text(top_hits(spark, sf), 5)


@query("results_lines",
       f"WITH {centroid_hits()}, k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, iid) AS r FROM h) "
       f"SELECT qid AS query_id, r AS line_no, {_LINE} AS line FROM k UNION ALL SELECT qid, 0, qid || ' found ' || count(*) FROM k GROUP BY qid")
def results_lines(spark, sf):
    return results.result_lines(similarity.search(centroids(spark, sf), items(spark, sf), rank=True))


@query("results_nested",
       f"WITH {neighbours(5)} SELECT qid AS query_id, '{{\"query\":\"' || qid || '\",\"results\":[' || string_agg('{{\"score\":' || d || ',\"RegID\":\"' || iid || '\"}}', ',' ORDER BY r) || ']}}' AS doc FROM n GROUP BY qid".replace("{{", "{").replace("}}", "}"))
def results_nested(spark, sf):
    return results.results_nested(top_hits(spark, sf), 5)


_PARSED = f"WITH {neighbours(5)} SELECT CAST(qid AS VARCHAR) AS query, d AS score, CAST(iid AS VARCHAR) AS item FROM n"


@query("parse_results_text", _PARSED)
def parse_results_text(spark, sf):
    return results.parse_results_text(results.results_text(top_hits(spark, sf), 5), "query_id")


@query("parse_results_nested", _PARSED)
def parse_results_nested(spark, sf):
    return results.parse_results_nested(results.results_nested(top_hits(spark, sf), 5))


@query("parse_service_lines",
       f"WITH {BOXES} SELECT round((rid % 100) / 100.0, 2)::DOUBLE AS score, 'id' || img AS id, 'id' || img || E'\\tf[' || x || ',' || y || ';' || w || ',' || h || ']' AS id_region FROM b WHERE rid % 9 <> 0")
def parse_service_lines(spark, sf):
    r, i = F.col("r"), F.col("rid")
    score = F.when(i % 9 == 0, "x").otherwise(F.format_string("%.2f", (i % 100) / 100))
    line = F.concat(score, F.lit("\tdir/img\tf{["), r["x"], F.lit(","), r["y"], F.lit(";"), r["w"], F.lit(","), r["h"],
                    F.lit("]\td[id"), F.col("img"), F.lit("]}"))
    return results.parse_service_lines(boxes(spark, sf).select(line.alias("line")))


@query("results_multi_json",
       f"WITH {centroid_hits()}, k AS (SELECT iid % 6 AS ev, qid, iid, d, row_number() OVER (PARTITION BY qid, iid % 6 ORDER BY d, iid) AS r FROM h QUALIFY r <= 4) "
       f"SELECT qid AS query_id, ev AS event_id, string_agg({_LINE}, E'\\n' ORDER BY r) AS result, CAST(count(*) AS BIGINT) AS matches FROM k GROUP BY ALL")
def results_multi_json(spark, sf):
    x = items(spark, sf).withColumn("by", F.col("item_id") % 6)
    every = F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(6)]))
    hits = similarity.search(centroids(spark, sf).withColumn("by", every), x, top_n=4)
    docs = results.results_by_collection(hits.withColumn("event_id", F.col("by").cast("bigint")), 4)
    back = F.from_json("doc", "array<struct<eventid: bigint, result: string, matches: bigint>>")
    return docs.select("query_id", F.explode(back).alias("c")).select(
        "query_id", F.col("c.eventid").alias("event_id"), "c.result", "c.matches"
    )


@query("import_tolerant",
       "SELECT doc_id, n_chars, doc_id % 8 <> 5 AS ok FROM documents WHERE doc_id % 8 <> 5 UNION ALL SELECT doc_id, NULL, false FROM documents WHERE doc_id % 8 = 5")
def import_tolerant(spark, sf):
    i = F.col("doc_id")
    size = F.when(i % 8 == 5, "many").otherwise(F.col("n_chars").cast("string"))
    lines = table(spark, sf, "documents").select(F.concat_ws("\t", i, "lang", size).alias("value"))
    good, bad = text.import_tolerant(spark, write_lines(spark, lines, "import"), "doc_id bigint, lang string, n_chars bigint")
    rejected = bad.select(F.substring_index("_line", "\t", 1).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("n_chars"))
    return good.select("doc_id", "n_chars", F.lit(True).alias("ok")).unionByName(rejected.withColumn("ok", F.lit(False)))
