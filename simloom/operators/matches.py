"""Matching of vector sets: row-to-row matches, their filters and the pair distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.functions import vectors
from simloom.functions.scalars import rounded, unit
from simloom.operators.prefix import numbered
from simloom.operators.similarity import Metric, _matrix, metric_of
from simloom.session import cut

MIN_MATCHES = 4


def set_distance(pairs: DataFrame, rows: DataFrame, scale: float = 1.0,
                 metric: str | Metric = "l2", block_rows: int = 1024) -> DataFrame:
    """Listed pairs of sets: mean nearest distance in both directions, averaged, normalised.

    ``pairs`` is (set_a, set_b), ``rows`` (set_id, row, vec). Sets up to ``block_rows`` rows lie in chunks; a tile of two chunks
    holds their rows once and the pairs pass it, so what moves for a pair is its two ids. Where few pairs are listed, rows go to the tiles of their own pairs only. Larger sets are compared piece by piece.
    """
    rows = rows.select("set_id", "row", vectors.doubles(F.col("vec")).alias("vec")).filter(F.size("vec") > 0)
    large = cut(rows.groupBy("set_id").agg(F.count("*").alias("n")).filter(F.col("n") > block_rows).select("set_id"))
    if large.isEmpty():
        return _in_tiles(pairs, rows, scale, metric_of(metric))
    some = large.withColumn("_l", F.lit(True))
    marked = pairs.join(some.withColumnRenamed("set_id", "set_a").withColumnRenamed("_l", "_la"), "set_a", "left").join(
        some.withColumnRenamed("set_id", "set_b").withColumnRenamed("_l", "_lb"), "set_b", "left")
    big = F.coalesce("_la", "_lb", F.lit(False))
    few = _in_tiles(marked.filter(~big).select("set_a", "set_b"), rows.join(large, "set_id", "left_anti"), scale, metric_of(metric))
    return few.unionByName(_in_pieces(marked.filter(big).select("set_a", "set_b"), rows, scale, metric_of(metric), block_rows))


#: Rows of the sets of a chunk.
CHUNK_ROWS = 4096


class _Chunk:
    """Rows sorted by set and row: where every set begins, and which rows are one (the same id twice)."""

    def __init__(self, sets: np.ndarray, rows: np.ndarray, mat: np.ndarray):
        order = np.lexsort((rows, sets))
        sets, rows, self.mat = sets[order], rows[order], mat[order]
        new = np.r_[True, sets[1:] != sets[:-1]] if len(sets) else np.zeros(0, bool)
        self.starts = np.flatnonzero(new)
        self.sets, self.ends = sets[self.starts], np.r_[self.starts[1:], len(sets)]
        self.first = new | np.r_[True, rows[1:] != rows[:-1]] if len(sets) else new

    def find(self, sets: np.ndarray) -> np.ndarray:
        """Position of each set, or -1."""
        if not len(self.sets):
            return np.full(len(sets), -1)
        at = np.minimum(np.searchsorted(self.sets, sets), len(self.sets) - 1)
        return np.where(self.sets[at] == sets, at, -1)


def _mean_nearest(m: Metric, a: _Chunk, i: int, b: _Chunk, js: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean nearest distances of set ``i`` of one chunk to sets ``js`` of the other, and back."""
    own = slice(a.starts[i], a.ends[i])
    if len(js) == len(b.sets):
        at = slice(None)
        lengths, first = b.ends - b.starts, b.first
    else:
        lengths = (b.ends - b.starts)[js]
        at = np.repeat(b.starts[js] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        first = b.first[at]
    d = m.block(a.mat[own], b.mat[at])
    sets = np.r_[0, np.cumsum(lengths)[:-1]]
    one = np.minimum.reduceat(np.minimum.reduceat(d, sets, axis=1), np.flatnonzero(a.first[own]), axis=0).mean(axis=0)
    # Rows with one id count once.
    heads = np.flatnonzero(first)
    back = np.minimum.reduceat(d.min(axis=0), heads)
    members = np.add.reduceat(first.astype(np.int64), sets)
    return one, np.add.reduceat(back, np.r_[0, np.cumsum(members)[:-1]]) / members


def _is_sparse(listed: DataFrame, rows: DataFrame, n: int, copies: int) -> bool:
    """Whether rows that go to the tiles of each pair of their set are copied less often than rows that go to all ``copies``."""
    sets = rows.agg(F.approx_count_distinct("set_id")).first()[0]
    return 2 * listed.count() * n < copies * max(1, sets)


def _range(number: Column, edges: list[float]) -> Column:
    """Which of the ranges between ``edges`` a number lies in."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < number)).cast("int")


def _in_tiles(pairs: DataFrame, rows: DataFrame, scale: float, m: Metric) -> DataFrame:
    """``set_distance`` of sets that fit a block."""
    rows = cut(rows)
    n = rows.count()
    chunks = max(1, -(-n // CHUNK_ROWS))
    listed = pairs.select(
        F.col("set_a").cast("bigint").alias("set_a"), F.col("set_b").cast("bigint").alias("set_b")).filter("set_a IS NOT NULL AND set_b IS NOT NULL")
    # Asking sets may be few: their chunks follow from their own number.
    asked = cut(listed.select(F.col("set_a").alias("set_id")).distinct())
    mine = rows.join(asked, "set_id", "left_semi")
    n_mine = mine.count()
    a_chunks = max(1, -(-n_mine // CHUNK_ROWS))
    vec, none = "array<double>", F.lit(None)
    empty = {"set_a": "bigint", "set_b": "bigint", "row": "bigint", "vec": vec}
    order = ("a", "b", "side", *empty)

    def filled(df: DataFrame, side: int) -> DataFrame:
        return df.withColumns({c: none.cast(t) for c, t in empty.items() if c not in df.columns}).withColumn("side", F.lit(side)).select(*order)

    ids = [F.col("set_id").cast("bigint").alias("set_a"), F.coalesce(F.col("row").cast("bigint"), F.lit(-(1 << 63))).alias("row"), "vec"]
    if chunks > 1 and _is_sparse(listed, rows, n, n * a_chunks + n_mine * chunks):
        # Rows go to the tiles that have pairs of their set. Sets near by number are often listed together: chunks are ranges.
        listed = cut(listed)
        edges = sorted({*rows.select(F.col("set_id").cast("double").alias("s")).approxQuantile("s", [i / chunks for i in range(1, chunks)], 0.25 / chunks)})
        dealt = listed.select(_range(F.col("set_a"), edges).alias("a"), _range(F.col("set_b"), edges).alias("b"), "set_a", "set_b")
        left, right = (
            rows.join(dealt.select(F.col(own).alias("set_id"), "a", "b").distinct(), "set_id").select("a", "b", *ids) for own in ("set_a", "set_b"))
    else:
        def chunk(name: str, n: int, seed: int) -> Column:
            return F.pmod(F.xxhash64(F.col(name).cast("bigint"), F.lit(seed)), F.lit(n)).cast("int")

        dealt = listed.select(chunk("set_a", a_chunks, 1).alias("a"), chunk("set_b", chunks, 2).alias("b"), "set_a", "set_b")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = mine.select(chunk("set_id", a_chunks, 1).alias("a"), every(chunks).alias("b"), *ids)
        right = rows.select(every(a_chunks).alias("a"), chunk("set_id", chunks, 2).alias("b"), *ids)
    tiles = filled(left, 0).unionByName(filled(right, 1)).unionByName(filled(dealt, 2))
    sorted_tiles = tiles.repartition("a", "b").sortWithinPartitions("a", "b", "side", "set_a", "set_b")

    def run(batches):
        tile, sides, held = None, [[], []], None
        for batch in batches:
            a, b, side = (batch.column(c).to_numpy() for c in ("a", "b", "side"))
            starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (side[1:] != side[:-1])])
            for s, e in zip(starts, np.r_[starts[1:], len(a)]):
                part = batch.slice(s, e - s)
                if (a[s], b[s]) != tile:
                    tile, sides, held, last = (a[s], b[s]), [[], []], None, None
                if side[s] < 2:
                    sides[side[s]].append((part.column("set_a").to_numpy(), part.column("row").to_numpy(), _matrix(part.column("vec"))))
                    continue
                if held is None:
                    held = [_Chunk(*[np.concatenate(c) for c in zip(*some)]) if some else None for some in sides]
                if held[0] is None or held[1] is None:
                    continue
                asks, others = part.column("set_a").to_numpy(), part.column("set_b").to_numpy()
                # A pair that is listed twice lies next to its copy.
                new = np.r_[last != (asks[0], others[0]), (asks[1:] != asks[:-1]) | (others[1:] != others[:-1])]
                last = asks[-1], others[-1]
                i, j = held[0].find(asks), held[1].find(others)
                met = np.flatnonzero(new & (i >= 0) & (j >= 0))
                edges = np.flatnonzero(np.r_[True, i[met][1:] != i[met][:-1]]) if len(met) else []
                for x, y in zip(edges, np.r_[edges[1:], len(met)] if len(met) else []):
                    at = met[x:y]
                    ab, ba = _mean_nearest(m, held[0], i[at[0]], held[1], j[at])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(asks[at], pa.int64()), pa.array(others[at], pa.int64()), pa.array((ab + ba) / 2, pa.float64())],
                        names=["set_a", "set_b", "d"])

    met = sorted_tiles.mapInArrow(run, "set_a bigint, set_b bigint, d double")
    return met.select("set_a", "set_b", rounded(unit(F.lit(scale) * F.col("d"))).alias("dist"))


def _in_pieces(pairs: DataFrame, rows: DataFrame, scale: float, m: Metric, block_rows: int) -> DataFrame:
    """``set_distance`` of sets of any size: a task emits one minimum per row of a piece, not every row pair."""
    sizes = rows.groupBy("set_id").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("splits"))
    blocks = (
        rows.join(sizes, "set_id")
        .withColumn("split", F.pmod(F.xxhash64("row"), F.col("splits")))
        .groupBy("set_id", "split")
        .agg(F.collect_list("row").alias("row"), F.collect_list("vec").alias("vec"))
        .drop("split")
    )
    left = blocks.select(F.col("set_id").alias("set_a"), F.col("row").alias("a_row"), F.col("vec").alias("a_vec"))
    right = blocks.select(F.col("set_id").alias("set_b"), F.col("row").alias("b_row"), F.col("vec").alias("b_vec"))
    met = pairs.join(left, "set_a").join(right, "set_b")

    def nearest(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1).to_pydict()
                d = m.block(np.array(one["a_vec"][0], float), np.array(one["b_vec"][0], float))
                na, nb = d.shape
                yield pa.RecordBatch.from_pydict(
                    {
                        "set_a": pa.array(one["set_a"] * (na + nb), pa.int64()),
                        "set_b": pa.array(one["set_b"] * (na + nb), pa.int64()),
                        "side": pa.array([0] * na + [1] * nb, pa.int32()),
                        "row": pa.array(one["a_row"][0] + one["b_row"][0], pa.int64()),
                        "d": pa.array(np.r_[d.min(axis=1), d.min(axis=0)], pa.float64()),
                    }
                )

    mins = met.mapInArrow(nearest, "set_a bigint, set_b bigint, side int, row bigint, d double")
    return (
        mins.groupBy("set_a", "set_b", "side", "row")
        .agg(F.min("d").alias("d"))
        .groupBy("set_a", "set_b")
        .agg(
            F.avg(F.when(F.col("side") == 0, F.col("d"))).alias("ab"),
            F.avg(F.when(F.col("side") == 1, F.col("d"))).alias("ba"),
        )
        .select("set_a", "set_b", rounded(unit(F.lit(scale) * (F.col("ab") + F.col("ba")) / 2)).alias("dist"))
    )


def crosscheck(hits: DataFrame, back: DataFrame | None = None) -> DataFrame:
    """Keep a pair only if each side is in the other's list.

    ``back`` holds the lists of the other set (its query_id are items of ``hits``); without it, both are one set.
    """
    swapped = (hits if back is None else back).select(F.col("item_id").alias("query_id"), F.col("query_id").alias("item_id"))
    return hits.join(swapped, ["query_id", "item_id"], "left_semi")


def ordered_pairs(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """i-th row with i-th row of each listed pair; sets of unequal length are an error."""
    sizes = rows.groupBy("set_id").agg(F.count("*").alias("n"))
    checked = (
        pairs.join(sizes.withColumnsRenamed({"set_id": "left_id", "n": "left_n"}), "left_id")
        .join(sizes.withColumnsRenamed({"set_id": "right_id", "n": "right_n"}), "right_id")
        .filter(
            F.coalesce(
                F.assert_true(F.col("left_n") == F.col("right_n"), "sets differ in length").isNull(),
                F.lit(True),
            )
        )
        .select("left_id", "right_id")
    )
    left = rows.select(F.col("set_id").alias("left_id"), "row", F.col(value).alias(f"left_{value}"))
    right = rows.select(F.col("set_id").alias("right_id"), "row", F.col(value).alias(f"right_{value}"))
    return checked.join(left, "left_id").join(right, ["right_id", "row"]).select(
        "left_id", "right_id", "row", f"left_{value}", f"right_{value}"
    )


def weight_mask(w1: Column, w2: Column, floor: float = 1e-5) -> Column:
    return F.sqrt(w1 * w2) > floor


def keep_near_min(found: DataFrame, radius: float, key: str = "pair") -> DataFrame:
    """Drop matches farther than max(2 * smallest of the pair, radius)."""
    least = found.groupBy(key).agg(F.min("dist").alias("_least"))
    return (
        found.join(least, key)
        .filter(F.col("dist") <= F.greatest(2 * F.col("_least"), F.lit(radius)))
        .drop("_least")
    )


def keep_central_half(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Drop the larger half of a pair's deviations from its median (the middle row stays)."""
    ready = rows.withColumn("_g", F.round(value, 9))
    sorted_rows = numbered(ready, [key], ["_g", *order], "_n")
    totals = sorted_rows.groupBy(key).agg(F.count("*").alias("_t"))
    middle = (
        sorted_rows.select(key, "_n", value)
        .join(totals, key)
        .filter((F.col("_n") == F.floor((F.col("_t") + 1) / 2)) | (F.col("_n") == F.floor(F.col("_t") / 2) + 1))
        .groupBy(key, "_t")
        .agg(F.avg(value).alias("_m"))
    )
    off = sorted_rows.drop("_n").join(middle, key).withColumn("_d", F.round(F.abs(F.col(value) - F.col("_m")), 9))
    return (
        numbered(off, [key], ["_d", *order], "_n")
        .filter(F.col("_n") <= F.floor((F.col("_t") + 1) / 2))
        .select(*rows.columns)
    )


def same_region(found: DataFrame, kinds: DataFrame, top_kinds: tuple[str, ...] = ("f", "p", "u", "s")
                ) -> DataFrame:
    """Matches must share a sub-region kind; if a side is a top-level kind, the distance doubles."""
    q = kinds.select(F.col("item_id").alias("query_id"), F.col("kind").alias("q_kind"))
    x = kinds.select("item_id", F.col("kind").alias("x_kind"))
    top = F.col("q_kind").isin(*top_kinds) | F.col("x_kind").isin(*top_kinds)
    same = F.col("q_kind") == F.col("x_kind")
    return (
        found.join(q, "query_id")
        .join(x, "item_id")
        .filter(same | top)
        .withColumn("dist", rounded(F.when(same, F.col("dist")).otherwise(2 * F.col("dist"))))
    )


def match_distance(found: DataFrame, keys: list[str], min_matches: int = MIN_MATCHES) -> DataFrame:
    """Pair distance as median, mean and maximum; too few matches at a non-zero distance give 1.

    Distances are kept to six decimals, so the exact median works on a bounded set of values.
    """
    few = F.col("_n") < min_matches

    def out(name: str) -> Column:
        d = F.col(name)
        return F.when(few & (d != 0), F.lit(1.0)).otherwise(rounded(d, 9)).alias(f"{name}_dist")

    return (
        found.groupBy(*keys)
        .agg(
            F.count("*").alias("_n"),
            F.median("dist").alias("median"),
            F.avg("dist").alias("mean"),
            F.max("dist").alias("max"),
        )
        .select(*keys, out("median"), out("mean"), out("max"))
    )
