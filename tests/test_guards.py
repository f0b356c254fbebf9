"""Defined results for inputs that used to pass unnoticed or were cut short."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from simloom.operators import ann, fusion, matches, region_merge, regions, registry, similarity
from simloom.session import scratch_path
from simloom.sources import results, tables, text

SF = "/root/testdata/sf0.01"


def vecs(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, vec array<double>")


def asked(df):
    return df.withColumnRenamed("item_id", "query_id")


def test_ragged_vectors_are_refused(spark):
    bad = vecs(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0, 4.0, 5.0])]).coalesce(1)
    with pytest.raises(Exception, match="one length"):
        similarity.search(asked(bad), bad, top_n=1).collect()


def test_widths_of_both_sides_must_agree(spark):
    a, b = vecs(spark, [(1, [1.0, 2.0])]), vecs(spark, [(2, [1.0, 2.0, 3.0])])
    with pytest.raises(Exception, match="values"):
        similarity.search(asked(a), b, top_n=1).collect()


@pytest.mark.parametrize("layout", [{}, {"scan_rows": 1, "block_rows": 2}])
def test_null_group_is_a_group(spark, layout):
    rows = [(1, None, [0.0]), (2, None, [1.0]), (3, "a", [0.0]), (4, "a", [2.0])]
    x = spark.createDataFrame(rows, "item_id bigint, by string, vec array<double>")
    got = similarity.search(asked(x), x, top_n=1, skip="id", **layout).collect()
    assert {(r["query_id"], r["item_id"]) for r in got} == {(1, 2), (2, 1), (3, 4), (4, 3)}


def test_a_list_needs_a_weight(spark):
    hits = spark.createDataFrame([(1, "a", 2, 0.5), (1, "b", 2, 0.5)], "query_id int, by string, item_id int, dist double")
    with pytest.raises(PySparkException, match="no weight"):
        fusion.fuse_mean(hits, {"a": 1.0}).collect()


def test_a_metric_needs_a_block():
    with pytest.raises(ValueError, match="block"):
        registry.register_metric("half", lambda a, b: F.lit(0.0), None)


def test_crosscheck_of_two_sets(spark):
    there = spark.createDataFrame([(1, 11, 0.1), (2, 11, 0.2)], "query_id int, item_id int, dist double")
    back = spark.createDataFrame([(11, 1, 0.1)], "query_id int, item_id int, dist double")
    assert [(r[0], r[1]) for r in matches.crosscheck(there, back).collect()] == [(1, 11)]


def test_first_lines_in_file_order(spark):
    path = scratch_path(spark, "list")
    spark.range(0, 5000, 1, 1).select(F.when(F.col("id") % 10 == 3, "# note").otherwise(F.concat(F.lit("f"), F.col("id"))).alias("value")).write.text(path)
    assert [r["file"] for r in text.scan_list(spark, path, top=4).collect()] == ["f0", "f1", "f2", "f4"]
    assert [r["file"] for r in text.scan_list(spark, path, keep_comments=True, top=4).collect()] == ["f0", "f1", "f2", "# note"]


def test_listing_of_many_tables(spark, monkeypatch):
    monkeypatch.setattr(tables, "NAMES_A_SCAN", 2)
    paths = []
    for i in range(5):
        paths.append(scratch_path(spark, "t") + ".parquet")
        tables.save_items(vecs(spark, [(i, [float(i)])]).select("item_id", F.lit(0).cast("bigint").alias("label"), F.lit("d").alias("dtype"), "vec"), paths[-1])
    listing = scratch_path(spark, "listing")
    spark.createDataFrame([(p,) for p in paths], "value string").coalesce(1).write.text(listing)
    assert sorted(r["item_id"] for r in tables.load_listed(spark, listing).collect()) == list(range(5))


def test_buckets_follow_the_items(spark, monkeypatch):
    monkeypatch.setattr(tables, "BUCKET_ITEMS", 10)
    path = scratch_path(spark, "per-item")
    tables.save_per_item(spark.range(95).select(F.col("id").alias("item_id")), path, {"a": 1.0})
    assert spark.read.parquet(path + "/payload").agg(F.max("bucket")).first()[0] == 9
    assert tables.load_per_item(spark, path).count() == 95


def test_whole_rankings_as_documents(spark, monkeypatch):
    monkeypatch.setattr(results, "PART_ENTRIES", 3)
    hits = spark.range(1, 8).select(F.lit(1).alias("query_id"), F.lit(5).alias("event_id"), F.col("id").alias("item_id"),
                                    (F.col("id") / 10).alias("dist"), F.col("id").cast("int").alias("rank"))
    docs = results.results_text(hits).orderBy("part").collect()
    assert len(docs) == 3 and all(d["doc"].startswith("1 found 7\n") for d in docs)
    assert sum(d["doc"].count("\n") for d in docs) == 7
    back = results.parse_results_nested(results.results_nested(hits)).collect()
    assert sorted(r["item"] for r in back) == [str(i) for i in range(1, 8)]
    assert results.results_by_collection(hits).count() == 3


def test_buckets_and_cells_follow_the_items(spark):
    x = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vec"))
    exact = similarity.search(asked(x), x, top_n=5, skip="id").select("query_id", "item_id")
    for join in (ann.lsh_neighbours, ann.cell_neighbours):
        got = join(asked(x), x, top_n=5)
        assert got.join(exact, ["query_id", "item_id"]).count() / exact.count() >= 0.9


def boxed(spark, rows, more=""):
    df = spark.createDataFrame(rows, "img bigint, rid bigint, line int, kind string, x int, y int, w int, h int" + more)
    return df.withColumn("r", F.struct("x", "y", "w", "h"))


def test_lists_are_intersected_in_order(spark):
    rows = [(1, 1, 0, "f", 0, 0, 40, 40), (1, 2, 1, "f", 2, 2, 40, 40), (1, 3, 1, "f", 200, 200, 40, 40), (1, 4, 2, "f", 300, 0, 40, 40),
            (2, 5, 3, "f", 0, 0, 40, 40), (2, 6, 3, "f", 90, 90, 40, 40)]
    got = {r["rid"]: (tuple(r["r"]), r["n"]) for r in regions.merge_regions(boxed(spark, rows), meet=True).collect()}
    assert got == {2: ((1, 1, 40, 40), 2), 5: ((0, 0, 40, 40), 1), 6: ((90, 90, 40, 40), 1)}
    union = regions.merge_regions(boxed(spark, rows)).collect()
    assert {r["rid"] for r in union} == {2, 3, 4, 5, 6}


@pytest.mark.parametrize("first,second,stays", [(("f", False), ("p", False), 1), (("f", False), ("p", True), 2), (("p", True), ("f", False), 1), (("p", False), ("f", False), 2)])
def test_an_ear_decides_between_face_and_profile(spark, first, second, stays):
    rows = [(1, 1, 0, first[0], 0, 0, 40, 40, first[1]), (1, 2, 0, second[0], 2, 2, 40, 40, second[1])]
    got = regions.merge_regions(boxed(spark, rows, ", ear boolean")).collect()
    assert [r["rid"] for r in got] == [stays]


def test_area_maps_have_any_shape(spark):
    got = regions.merge_regions(boxed(spark, [(1, 1, 0, "s", 0, 0, 100, 10), (1, 2, 0, "f", 0, 200, 100, 10)])).collect()
    assert [r["rid"] for r in got] == [1]
    assert region_merge.merge_rows([(1, "p", (0, 0, 40, 40), True), (2, "p", (1, 1, 40, 40), False)], "avg", 0.5, 8, 1.2)[0][1] == "p"


def test_children_are_enclosed_before_the_clip(spark):
    sub = "array<struct<kind: string, x: int, y: int, w: int, h: int>>"
    df = spark.createDataFrame([(1, (10, 10, 20, 20), [("e", 15, 5, 15, 5), ("n", -30, 0, 5, 5)])],
                               f"img bigint, r struct<x: int, y: int, w: int, h: int>, subs {sub}")
    bounds = spark.createDataFrame([(1, 35, 100)], "img bigint, bw int, bh int")
    r = regions.clip_regions(df, bounds).first()
    assert tuple(r["r"]) == (0, 10, 35, 20)
    assert [tuple(s)[-4:] for s in r["subs"]] == [(25, 5, 10, 5)]


def test_only_faces_are_primed(spark):
    rows = [(1, 1, 0, "f", 0, 0, 9, 9), (1, 2, 0, "e", 20, 20, 9, 9), (1, 3, 0, "p", 20, 20, 9, 9)]
    ordered = boxed(spark, rows).withColumn("rank", F.col("rid"))
    points = spark.createDataFrame([(1, 22, 22)], "img bigint, px int, py int")
    got = {r["rid"]: r["new_rank"] for r in regions.prime_region(ordered, points).collect()}
    assert got == {3: 1, 1: 2, 2: 3}
