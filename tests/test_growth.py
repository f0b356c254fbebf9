"""What moves and what is computed grows with the tables: sketches by batch, parts of a join, histograms."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from simloom.functions.vectors import SKETCH_PRIME
from simloom.operators import evaluate, neardup, similarity


def plain_sketch(words):
    ab = [(int(d[:8], 16), int(d[8:16], 16)) for d in (hashlib.md5(w.encode()).hexdigest() for w in words)]
    return [min((a + i * b) % SKETCH_PRIME for a, b in ab) for i in range(16)]


def test_sketches_of_a_batch_equal_plain_ones(spark):
    texts = [(1, 0, "One two\tTWO  three"), (1, 1, "two"), (2, 0, None), (3, 0, ""), (4, 0, " \n\x0b "), (5, 0, "\u00c4rger \u6f22\u5b57 \U0001f600 \u00a0x"),
             (6, 0, "left half"), (6, 0, "right half"), (None, 0, "no key"), (None, 0, "none either")]
    df = spark.createDataFrame(texts, "id bigint, part int, text string")
    want = {}
    for a, b, t in texts:
        words = {w for w in (t or "").lower().translate(str.maketrans("\t\n\x0b", "   ")).split(" ") if w}
        if words:
            want.setdefault((a, b), set()).update(words)
    got = neardup.sketched(df, "id", "part")
    assert got.columns == ["id", "part", "sketch"]
    assert {(r.id, r.part): r.sketch for r in got.collect()} == {k: plain_sketch(w) for k, w in want.items()}
    assert "Generate" not in got._jdf.queryExecution().toString()  # no row per word
    assert neardup.sketched(df.filter("false"), "id").collect() == []


def test_sketches_of_runs_of_texts_equal_those_of_a_batch():
    texts = pa.array(["", None, "a b a", " ", "cd", "b\ta ", "x" * 50, "\u00e9\x0bb"])
    has, whole = neardup._minima(texts, 16)
    assert has.tolist() == [False, False, True, False, True, True, True, True]
    assert whole.to_pylist() == [plain_sketch(w) for w in ("ab", ["cd"], "ab", ["x" * 50], "\u00e9b")]
    part, some = neardup._minima(texts.slice(2, 4), 16)
    assert part.tolist() == [True, False, True, True] and some.to_pylist() == whole.to_pylist()[:3]
    assert not len(neardup._minima(texts.slice(0, 2), 16)[1]) and not len(neardup._minima(texts.slice(0, 0), 16)[1])


@pytest.mark.parametrize("mirror", [False, True])
def test_parts_of_a_join_do_not_grow_with_its_rows(mirror):
    parts = {similarity._even_parts(n, n, 96, similarity.BLOCK_ROWS, mirror, similarity.MOST_HELD_BLOCKS) for n in (10_256, 102_564, 615_384)}
    assert parts == {(14, 14) if mirror else (10, 10)}


def test_long_vectors_and_many_results_are_held_in_fewer_rows(spark, monkeypatch):
    held = []
    layout = similarity._gridded
    monkeypatch.setattr(similarity, "_gridded", lambda *args: held.append(args[-1]) or layout(*args))
    x = spark.createDataFrame([(i, [float(i)] * 2000) for i in range(4)], "item_id bigint, vec array<double>")
    q = x.withColumnRenamed("item_id", "query_id")
    similarity.search(q, x.selectExpr("item_id", "slice(vec, 1, 2000) AS vec"), top_n=2, scan_rows=0)
    short = [df.selectExpr(df.columns[0], "slice(vec, 1, 8) AS vec") for df in (q, x)]
    similarity.search(*short, top_n=2, scan_rows=0)
    similarity.search(*short, top_n=5000, scan_rows=0)
    assert held == [similarity.HELD_BLOCKS, similarity.MOST_HELD_BLOCKS, similarity.HELD_BLOCKS]


@pytest.mark.parametrize("scale", [None, 1.0])
def test_histograms_equal_all_pairs(spark, scale):
    rng = np.random.default_rng(4)
    mat = np.r_[np.repeat(rng.normal(size=(12, 3)), 2, axis=0), rng.normal(size=(40, 3)), [[90.0, 0.0, 0.0]]]
    tag = rng.integers(0, 5, len(mat))
    x = spark.createDataFrame([(i, int(t), [float(v) for v in r]) for i, (t, r) in enumerate(zip(tag, mat))], "item_id bigint, label bigint, vec array<double>")
    d = np.sqrt(((mat[:, None] - mat[None]) ** 2).sum(axis=2))
    bins = np.rint((d if scale is None else 2 / np.pi * np.arctan(np.pi / 2 * d)) * 1000).astype(int)
    other = ~np.eye(len(mat), dtype=bool)
    same = other & (tag[:, None] == tag[None])
    want = sorted((b, int((bins[same] == b).sum()), int((bins[other & ~same] == b).sum())) for b in np.unique(bins[other]).tolist())
    for layout in ({}, {"scan_rows": 0, "block_rows": 2}):
        assert sorted(map(tuple, evaluate.pair_counts(x, scale=scale, digits=3, **layout).collect())) == want
