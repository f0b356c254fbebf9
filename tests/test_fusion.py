"""The threshold algorithm against the fusion of whole lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from simloom.operators import fusion, similarity

WEIGHTS = {"a": 0.2, "b": 0.5, "c": 0.9}


def lists(spark, n=80, seed=4, drop=0):
    """Items near a few centres, the same centre in each list, with one repeated vector; ``drop`` leaves some out of a list."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, 9)) * 3
    mat = centre[np.arange(n) % 6] + rng.normal(size=(n, 9)) * 0.3
    mat[7] = mat[1]
    rows = [(i, by, [float(v) for v in mat[i, 3 * j:3 * j + 3]]) for i in range(n) for j, by in enumerate("abc") if not (by == "b" and i < drop)]
    return spark.createDataFrame(rows, "item_id bigint, by string, vec array<double>")


def whole(items, queries, how, k, **options):
    hits = similarity.search(queries, items, top_n=1000, scale=1.0)
    fused = fusion.FUSIONS[how](hits, WEIGHTS, **options)
    return sorted(map(tuple, similarity.ranked(fused, k).select("query_id", "item_id", "dist").collect()))


@pytest.mark.parametrize("how,options", [("mean", {}), ("product", {"scale": 1.6}), ("radicals", {}), ("borda", {})])
@pytest.mark.parametrize("drop", [0, 9])
def test_top_of_whole_lists(spark, monkeypatch, how, options, drop):
    items = lists(spark, drop=drop)
    queries = items.filter("item_id % 13 = 1").withColumnRenamed("item_id", "query_id")
    want = whole(items, queries, how, 5, **options)
    asked, search = [], similarity.search
    monkeypatch.setattr(similarity, "search", lambda *a, **k: asked.append(k["top_n"]) or search(*a, **k))
    got = sorted(map(tuple, fusion.top_fused(queries, items, WEIGHTS, how, 5, depth=6, fused_scale=options.get("scale")).collect()))
    assert got == want
    # Lists of one item set stop before their end; with items that a list lacks they are read whole.
    assert asked[0] == (6 if not drop else 80) and (asked[-1] < 80 or drop or how == "borda")


def test_more_wanted_than_there_is(spark):
    items = lists(spark, n=12)
    queries = items.filter("item_id = 3").withColumnRenamed("item_id", "query_id")
    got = fusion.top_fused(queries, items, WEIGHTS, "mean", 50, depth=2)
    assert got.count() == 12 and whole(items, queries, "mean", 50) == sorted(map(tuple, got.collect()))
    assert fusion.top_fused(queries, items.filter("false"), WEIGHTS, "mean").count() == 0
    assert fusion.top_fused(queries.filter("false"), items, WEIGHTS, "borda").count() == 0


def test_a_list_without_a_weight_is_an_error(spark):
    items = lists(spark, n=12).withColumn("by", F.when(F.col("by") == "a", "z").otherwise(F.col("by")))
    with pytest.raises(Exception, match="no weight"):
        fusion.top_fused(items.withColumnRenamed("item_id", "query_id"), items, WEIGHTS, "borda", 3).collect()
