"""Near-duplicate links against brute force, with hot buckets forced through every path."""

import random

import pytest
from pyspark.sql import functions as F

from simloom.operators import components, neardup
from simloom.operators.prefix import numbered, running


def sketches(n=120, seed=5):
    """A third are copies of one sketch, a third are one or two changes away from it."""
    rnd = random.Random(seed)
    base = [rnd.randrange(1000) for _ in range(16)]
    out = []
    for i in range(n):
        s = list(base) if i % 3 < 2 else [rnd.randrange(1000) for _ in range(16)]
        if i % 3 == 1:
            for _ in range(rnd.randrange(1, 6)):
                s[rnd.randrange(16)] = rnd.randrange(1000)
        out.append(s)
    return out


def brute(asks, answers, least):
    want = {}
    for q, s in asks:
        best = max(((sum(a == b for a, b in zip(s, t)), -x) for x, t in answers if x < q), default=None)
        if best and best[0] >= least and (q not in want or best > want[q]):
            want[q] = best
    return {q: -b[1] for q, b in want.items()}


def table(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, sketch array<bigint>")


@pytest.mark.parametrize("group_rows", [256, 4])
def test_links_match_brute_force(spark, group_rows):
    rows = list(enumerate(sketches()))
    least = neardup.min_agreement(neardup.TEXT_SCALE, 0.1, 16)
    assert least == 12
    got = neardup.link(table(spark, rows), group_rows=group_rows).collect()
    assert {r.seq: r.parent for r in got} == brute(rows, rows, least)
    assert all(0 <= r.dist < 0.1 for r in got)


def test_probes_match_brute_force(spark):
    rows = list(enumerate(sketches(60)))
    rnd = random.Random(9)
    probes = rows + [(i, [rnd.randrange(3) if rnd.random() < 0.1 else v for v in s]) for i, s in rows]
    for group_rows in (256, 4):
        got = neardup.link_probes(table(spark, probes), table(spark, rows), group_rows=group_rows).collect()
        assert {r.seq: r.parent for r in got} == brute(probes, rows, 12)


def test_groups_and_representatives(spark):
    links = spark.createDataFrame([(5, 4, 0.0), (4, 3, 0.0), (3, 2, 0.0), (2, 1, 0.0), (9, 8, 0.0)], "seq bigint, parent bigint, dist double")
    items = spark.createDataFrame([(i, 100 if i in (3, 4) else 1) for i in range(1, 11)], "seq bigint, area int")
    grouped = neardup.with_groups(items, links)
    assert {r.seq: r.grp for r in grouped.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: None, 7: None, 8: 8, 9: 8, 10: None}
    assert {r.grp: r.rep for r in neardup.representatives(grouped).collect()} == {1: 3, 8: 8}
    assert sorted(r.seq for r in neardup.unique(grouped).collect()) == [3, 6, 7, 8, 10]
    assert {r.seq: r.rep for r in neardup.pairs(grouped).collect()} == {1: 3, 2: 3, 3: None, 4: 3, 5: 3, 8: None, 9: 8}


def test_sketch_reads_whole_texts(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    docs = spark.createDataFrame([(1, long), (2, long + " tail"), (3, "other words here"), (4, "  \n ")], "doc bigint, text string")
    got = {r.doc: r.sketch for r in neardup.sketched(docs, "doc").collect()}
    assert set(got) == {1, 2, 3}
    assert sum(a == b for a, b in zip(got[1], got[2])) >= 15
    assert not any(a == b for a, b in zip(got[1], got[3]))


def test_components_match_union_find(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)]
    edges += [(200, 201 + i) for i in range(40)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == {n: find(n) for n in linked}


def test_running_over_a_hot_key(spark):
    rnd = random.Random(4)
    rows = [("hot" if i % 3 else f"k{i % 5}", i, rnd.randrange(100)) for i in range(500)] + [(None, i, i) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint").repartition(5)
    plain = numbered(df, ["k"], ["v", "i"]).collect()
    spread = numbered(df, ["k"], ["v", "i"], hot_rows=0).collect()
    assert sorted(map(str, plain)) == sorted(map(str, spread))
    a = running(df, ["k"], ["i"], total=("sum", F.col("v")), top=("max", F.col("v"))).collect()
    b = running(df, ["k"], ["i"], hot_rows=0, total=("sum", F.col("v")), top=("max", F.col("v"))).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    whole = running(df.filter("k is not null"), [], ["i"], n=("count", None)).collect()
    assert sorted(r.n for r in whole) == list(range(1, 501))


def test_a_band_that_half_of_the_rows_share(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(600):
        s = [rnd.randrange(40) for _ in range(16)]
        if i % 2:
            s[0::5] = [7, 7, 7, 7]
        rows.append((i, s if i % 10 else [*rows[i - 5][1][:15], 3] if i > 10 else s))
    want = brute(rows, rows, 12)
    for group_rows in (512, 16):
        got = neardup.link(table(spark, rows), group_rows=group_rows).collect()
        assert {r.seq: r.parent for r in got} == want


@pytest.mark.parametrize("group_rows", [512, 5])
def test_against_matches_brute_force(spark, group_rows):
    rows = list(enumerate(sketches(90)))
    asks, answers = rows[:30], rows[20:]
    q = spark.createDataFrame(asks, "query_id bigint, sketch array<bigint>")
    x = spark.createDataFrame(answers, "item_id bigint, sketch array<bigint>")
    want = {(a, b) for a, s in asks for b, t in answers if sum(u == v for u, v in zip(s, t)) >= 12}
    got = neardup.against(q, x, group_rows=group_rows).collect()
    assert {(r.query_id, r.item_id) for r in got} == want and len(got) == len(want)
