"""Exact similarity joins between a query table and an item table.

Queries are ``(query_id, vec)`` and items ``(item_id, vec)``, each with an optional ``by`` column
(only rows of one ``by`` value meet) and an optional ``tag`` for block functions. Two layouts:

* *scan*: the query set fits a checked bound, so it is broadcast and every task walks its own items
  once; nothing is shuffled but the per-task winners.
* *grid*: rows lie in cells around pivots, and cell pairs that the triangle inequality rules out are
  dropped. What is left of a pair of cells is a grid of tiles: the queries of the cell are cut into a few parts, its
  items into others, and a row is sent to every tile of its part (fragment and replicate). A task holds the queries of
  a tile, whose number is bounded, and streams its items past them. So a row is copied as often as the other side
  has parts, not blocks, and a hot region of space is many tiles.

In both, a task reduces a block of distances on the spot (top-k, radius, counts): candidate pairs
never become rows. Cells are only made where they rule out a good part of the pairs; without them both sides are cut
into even parts. A reduction that doesn't tell the two sides of a table joined with itself apart compares each pair of parts once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simloom.functions import scalars, vectors
from simloom.operators.prefix import numbered
from simloom.session import cut

SCAN_ROWS = 4096
SCAN_BYTES = 64 << 20
BLOCK_ROWS = 2048
#: Blocks of queries that a tile of a pair of cells holds, and of items that it streams.
HELD_BLOCKS, STREAMED_BLOCKS = 8, 64
#: Blocks of queries that a tile of the even layout holds at most, while they and their results stay under so many bytes.
MOST_HELD_BLOCKS, HELD_BYTES = 64, 256 << 20
#: Pivots grow with the square root of the rows up to this number per ``by`` value, and over all of them.
MAX_PIVOTS = 512
ALL_PIVOTS = 1024
MAX_KINDS = 512
#: Distances that are computed at once, and those whose chain of steps stays in a core's cache.
TILE_CELLS, CHAIN_CELLS = 1 << 20, 1 << 17
#: Tiles per core where the table alone sets no number; share of the pairs that pivots have to rule out to be worth their copies.
TILES_PER_CORE, PRUNED_SHARE = 8, 0.5
#: Share of a block that a screen may leave; above it all distances are computed.
SCREENED_SHARE = 0.1


# ---------------------------------------------------------------- metrics


def _by_column(step: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    def kernel(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), len(x)))
        for j in range(q.shape[1]):
            out += step(q[:, j, None], x[None, :, j])
        return out

    return kernel


def squares(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all pairs of rows, by one matrix product."""
    qq, xx = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", x, x)
    sq = np.c_[-2.0 * q, qq, np.ones(len(q))] @ np.c_[x, np.ones(len(x)), xx].T
    # Near zero the difference of large sums is noise: take those cells again, term by term.
    close = np.flatnonzero(sq.min(axis=1, initial=np.inf) < 1e-7 * (qq + xx.max(initial=0.0)))
    for i in close:
        c = np.flatnonzero(sq[i] < 1e-7 * (qq[i] + xx))
        sq[i, c] = ((q[i] - x[c]) ** 2).sum(axis=1)
    return np.maximum(sq, 0.0, out=sq)


def _l2_block(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    sq = squares(q, x)
    return np.sqrt(sq, out=sq)


def _hamming_block(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    a, b = (q > 0).astype(np.float64), (x > 0).astype(np.float64)
    return a @ (1 - b).T + (1 - a) @ b.T


@dataclass(frozen=True)
class Metric:
    """A distance as a column expression and as a block kernel (queries x items)."""

    name: str
    expr: Callable[[Column, Column], Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]
    triangle: bool


METRICS: dict[str, Metric] = {
    m.name: m
    for m in (
        Metric("l1", vectors.dist_l1, _by_column(lambda a, b: np.abs(a - b)), True),
        Metric("l2", vectors.dist_l2, _l2_block, True),
        Metric(
            "hamming",
            lambda a, b: vectors.dist_hamming(vectors.pack_bits(a), vectors.pack_bits(b)),
            _hamming_block,
            True,
        ),
        Metric(
            "chi2",
            vectors.dist_chi2,
            _by_column(lambda a, b: (a - b) ** 2 * (a != 0) / np.where(a != 0, a, 1.0)),
            False,
        ),
    )
}


def metric_of(name: str | Metric) -> Metric:
    return name if isinstance(name, Metric) else METRICS[name]


# ---------------------------------------------------------------- blocks of rows


@dataclass
class Block:
    ids: np.ndarray
    mat: np.ndarray
    tag: np.ndarray | None

    def rows(self, where) -> Block:
        return Block(self.ids[where], self.mat[where], None if self.tag is None else self.tag[where])


class Reducer:
    """What the pairs of a block of queries come to: rows that ``add`` yields at once, and those that ``rows`` ends with.

    ``times`` is 2 for a pair of parts that stands for its mirror image as well.
    """

    def add(self, q: Block, x: Block, times: int) -> Iterator[list[np.ndarray]]:
        raise NotImplementedError

    def rows(self) -> Iterator[list[np.ndarray]]:
        return iter(())


def unit_values(d: np.ndarray, scale: float) -> np.ndarray:
    """[0, inf) -> [0, 1)."""
    d = d * (np.pi / 2 * scale)
    np.arctan(d, out=d)
    d *= 2 / np.pi
    return d


def _flat(col: pa.Array) -> np.ndarray:
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        return np.array(col.to_pylist(), dtype=np.str_)
    return col.to_numpy(zero_copy_only=False)


def _matrix(col: pa.Array) -> np.ndarray:
    if len(col) == 0:
        return np.empty((0, 1))
    lengths = pc.list_value_length(col)
    width = lengths[0].as_py()
    if pc.any(pc.not_equal(lengths, width)).as_py():
        raise ValueError("vectors of one search must have one length")
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _groups(by: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    """Row positions of each ``by`` value of a batch."""
    coded = by.dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    edges = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
    for i, name in enumerate(coded.dictionary.to_pylist()):
        yield name, order[edges[i] : edges[i + 1]]


def _same_width(q: Block, x: Block) -> None:
    if len(q.ids) and len(x.ids) and q.mat.shape[1] != x.mat.shape[1]:
        raise ValueError(f"queries have {q.mat.shape[1]} values and items {x.mat.shape[1]}")


def slabs(q: Block, x: Block, cells: int) -> Iterator[Block]:
    """The items in runs of so many that a run has about ``cells`` pairs with the queries."""
    step = max(1, cells // max(1, len(q.ids)))
    for s in range(0, len(x.ids), step):
        yield x.rows(slice(s, s + step))


def _emit(name: str, cols: list[np.ndarray], schema: pa.Schema, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    for s in range(0, len(cols[0]), most):
        part = [c[s : s + most] for c in cols]
        by = pa.repeat(pa.scalar(name, schema[0].type), len(part[0]))
        yield pa.RecordBatch.from_arrays([by, *[pa.array(c, type=f.type) for c, f in zip(part, list(schema)[1:])]], schema=schema)


def _prepare(df: DataFrame, key: str) -> DataFrame:
    """Uniform columns (id, by, tag, vec); rows without a vector have no neighbours.

    A NULL ``by`` is a group of its own, named by the empty text.
    """
    cols = df.columns
    return df.select(
        F.col(key).alias("id"),
        F.coalesce((F.col("by") if "by" in cols else F.lit("")).cast("string"), F.lit("")).alias("by"),
        (F.col("tag") if "tag" in cols else F.lit(0)).cast("bigint").alias("tag"),
        vectors.doubles(F.col("vec")).alias("vec"),
    ).filter(F.size("vec") > 0)


def pair_reduce(
    queries: DataFrame,
    items: DataFrame,
    make: Callable[[], Reducer],
    schema: T.StructType,
    metric: str | Metric = "l2",
    max_dist: float | None = None,
    top_n: int | None = None,
    scan_rows: int = SCAN_ROWS,
    block_rows: int = BLOCK_ROWS,
    grid: int | None = None,
    shared: bool = False,
    whole_rows: int | None = None,
    kept: int = 64,
) -> DataFrame:
    """Let every (query block, item block) meet in a reducer and return the rows that come out.

    ``make`` gives a reducer for each block of queries, or with ``shared`` one for all blocks of a task; then both tables are the
    same one, and with a symmetric metric (one that prunes) two parts meet on one side only. ``max_dist`` and
    ``top_n`` say which cell pairs may be skipped; without either, all pairs meet. ``grid`` cuts each
    side of a pair of cells into that many parts instead of parts of bounded size. ``whole_rows`` lets so many queries meet all items in
    one task. ``kept`` is the number of results that a reducer holds for a query. The output has a leading ``by`` column.
    """
    q, x = _prepare(queries, "query_id"), _prepare(items, "item_id")
    out = T.StructType([T.StructField("by", T.StringType()), *schema.fields])
    fields = out.fieldNames()
    if whole_rows is None:
        held = q.limit(scan_rows + 1).toArrow().combine_chunks()
        if held.num_rows <= scan_rows and held.nbytes <= SCAN_BYTES:
            return _scan(x, held, make, out).select(*fields)
        row = 1.5 * held.nbytes / held.num_rows + 40 * kept  # a vector, its single-precision copy and results
        held_blocks = max(HELD_BLOCKS, min(MOST_HELD_BLOCKS, int(HELD_BYTES / row) // block_rows))
    else:
        held_blocks = HELD_BLOCKS
    return _gridded(q, x, make, out, metric_of(metric), max_dist, top_n, block_rows, grid, shared, whole_rows, held_blocks).select(*fields)


def _arrow_schema(out: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(out)


def _scan(x: DataFrame, held: pa.Table, make: Callable[[], Reducer], out: T.StructType) -> DataFrame:
    by_value: dict[str, tuple] = {}
    if held.num_rows:
        ids = _flat(held.column("id").combine_chunks())
        tags = held.column("tag").to_numpy()
        vecs = held.column("vec").combine_chunks()
        for name, where in _groups(held.column("by").combine_chunks()):
            by_value[name] = (ids[where], _matrix(vecs.take(pa.array(where))), tags[where])
    shared = x.sparkSession.sparkContext.broadcast(by_value)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema(out)
        sides = {name: Block(*side) for name, side in shared.value.items()}
        reducers: dict[str, Reducer] = {}
        for batch in batches:
            for name, where in _groups(batch.column("by")):
                q = sides.get(name)
                if q is None:
                    continue
                part = batch if len(where) == batch.num_rows else batch.take(pa.array(where))
                block = Block(
                    _flat(part.column("id")),
                    _matrix(part.column("vec")),
                    part.column("tag").to_numpy(),
                )
                _same_width(q, block)
                if name not in reducers:
                    reducers[name] = make()
                for cols in reducers[name].add(q, block, 1):
                    yield from _emit(name, cols, schema)
        for name, reducer in reducers.items():
            for cols in reducer.rows():
                yield from _emit(name, cols, schema)

    return x.mapInArrow(run, out)


def _pivots(x: DataFrame) -> dict[str, np.ndarray]:
    """A bounded sample of vectors per ``by`` value, spread by hash; none for very many values."""
    n, kinds = x.agg(F.count("*"), F.approx_count_distinct("by")).first()
    if kinds > MAX_KINDS:
        return {}
    per = max(1, min(MAX_PIVOTS, int((n / max(1, kinds)) ** 0.5) // 8, ALL_PIVOTS // max(1, kinds)))
    w = Window.partitionBy("by").orderBy(F.xxhash64("id"), "id")
    rows = (
        x.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per).select("by", "vec")
    ).toArrow()
    vecs = rows.column("vec").combine_chunks()
    return {
        name: _matrix(vecs.take(pa.array(where)))
        for name, where in _groups(rows.column("by").combine_chunks())
    }


def _with_cells(df: DataFrame, pivots, metric: Metric) -> DataFrame:
    """Nearest pivot and the distance to it; one cell where there are no pivots."""
    if not pivots:
        return df.withColumn("cell", F.lit(0)).withColumn("reach", F.lit(0.0))
    shared = df.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType(
        [*df.schema.fields, T.StructField("cell", T.IntegerType()),
         T.StructField("reach", T.DoubleType())]
    )

    def run(batches):
        arrow = _arrow_schema(schema)
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            reach = np.zeros(batch.num_rows)
            for name, where in _groups(batch.column("by")):
                centres = shared.value.get(name)
                if centres is not None:
                    d = metric.block(_matrix(batch.column("vec").take(pa.array(where))), centres)
                    cell[where] = d.argmin(axis=1)
                    reach[where] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(reach)], schema=arrow
            )

    return df.mapInArrow(run, schema)


def _cell_stats(df: DataFrame, part_rows: int, grid: int | None) -> DataFrame:
    """Rows, reach and number of parts per cell."""
    parts = F.lit(grid) if grid else F.ceil(F.col("n") / part_rows)
    return df.groupBy("by", "cell").agg(F.count("*").alias("n"), F.max("reach").alias("r")).withColumn("splits", parts.cast("int"))


def _held(stats: DataFrame) -> dict[str, dict[int, tuple[int, float, int]]]:
    out: dict[str, dict[int, tuple[int, float, int]]] = {}
    for by, cell, n, r, splits in stats.collect():  # one row per pivot
        out.setdefault(by, {})[cell] = (n, r, splits)
    return out


def _kept_cells(metric, pivots, qs, xs, max_dist, top_n):
    """Cell pairs that can hold a wanted pair, per ``by`` value."""
    kept = []
    for by in qs.keys() & xs.keys():
        gaps = metric.block(pivots[by], pivots[by])
        for qc, (_, qr, _) in qs[by].items():
            low = {c: max(0.0, gaps[qc, c] - qr - r) for c, (_, r, _) in xs[by].items()}
            limit = np.inf if max_dist is None else max_dist
            if top_n is not None:
                seen = 0  # the radius that surely holds top_n items for every query of the cell
                far = sorted((gaps[qc, c] + qr + r, n) for c, (n, r, _) in xs[by].items())
                for high, n in far:
                    seen += n
                    if seen >= top_n:
                        limit = min(limit, high)
                        break
            kept += [(by, qc, c, xs[by][c][2]) for c, d in low.items() if d <= limit * (1 + 1e-9) + 1e-6]
    return kept


_TILE = ("by", "q_cell", "q_split", "x_cell", "x_split")


def _even_parts(nq: int, nx: int, tiles: float, block_rows: int, mirror: bool, held_blocks: int) -> tuple[int, int]:
    """Parts of each side, of bounded size, for about ``tiles`` tiles; as square as the sides are long, which copies fewest rows."""
    held, streamed = held_blocks * block_rows, STREAMED_BLOCKS * block_rows
    if mirror:
        parts = max(math.ceil(nq / held), min(math.ceil((2 * tiles) ** 0.5), math.ceil(nq / 64)))
        return parts, parts
    xs = max(math.ceil(nx / streamed), min(math.ceil((tiles * nx / nq) ** 0.5), math.ceil(nx / 512)))
    return max(math.ceil(nq / held), min(math.ceil(tiles / xs), math.ceil(nq / 64))), xs


def _uncut(q: DataFrame, x: DataFrame, block_rows: int, grid: int | None, mirror: bool, whole_rows: int | None,
           held_blocks: int):
    """Both sides in one cell per ``by`` value, and the parts that the sides of each are cut into."""
    q, x = _with_cells(q, {}, METRICS["l2"]), _with_cells(x, {}, METRICS["l2"])
    q_stats, x_stats = _cell_stats(q, HELD_BLOCKS * block_rows, grid), _cell_stats(x, STREAMED_BLOCKS * block_rows, grid)
    both = q_stats.select("by", F.col("n").alias("nq"), F.col("cell").alias("q_cell"), F.col("splits").alias("q_splits")).join(
        x_stats.select("by", F.col("n").alias("nx"), F.col("cell").alias("x_cell"), F.col("splits").alias("x_splits")), "by")
    few = both.limit(MAX_KINDS + 1).collect() if grid is None else []
    if grid is None and len(few) <= MAX_KINDS:  # one row per ``by`` value
        tiles = TILES_PER_CORE * x.sparkSession.sparkContext.defaultParallelism
        total = sum(r["nq"] * r["nx"] for r in few)
        rows = []
        for r in few:
            share = tiles * r["nq"] * r["nx"] / total
            parts = _even_parts(r["nq"], r["nx"], share, block_rows, mirror, held_blocks)
            if whole_rows is not None:
                parts = max(math.ceil(r["nq"] / whole_rows), min(r["nq"], math.ceil(share / 2))), 1
            rows.append((r["by"], 0, parts[0], 0, parts[1]))
        pairs = F.broadcast(x.sparkSession.createDataFrame(rows, _PAIRS))
    elif whole_rows is not None:
        pairs = both.select("by", "q_cell", F.ceil(F.col("nq") / whole_rows).cast("int").alias("q_splits"), "x_cell", F.lit(1).alias("x_splits"))
    elif mirror:
        most = F.greatest("q_splits", "x_splits")
        pairs = both.select("by", "q_cell", most.alias("q_splits"), "x_cell", most.alias("x_splits"))
    else:
        pairs = both.select("by", "q_cell", "q_splits", "x_cell", "x_splits")
    return q, x, pairs


def _in_cells(q, x, metric: Metric, max_dist, top_n, block_rows: int, grid: int | None):
    """Both sides in cells and the pairs of cells that are left; None where pivots rule out too little."""
    pivots = _pivots(x)
    if not pivots:
        return None
    q = q.filter(F.col("by").isin(list(pivots)))
    q, x = _with_cells(q, pivots, metric), _with_cells(x, pivots, metric)
    q_stats, x_stats = _cell_stats(q, HELD_BLOCKS * block_rows, grid), _cell_stats(x, STREAMED_BLOCKS * block_rows, grid)
    qs, xs = _held(q_stats), _held(x_stats)  # both tables of cells are bounded by the number of pivots
    kept = _kept_cells(metric, pivots, qs, xs, max_dist, top_n)
    total = sum(sum(n for n, _, _ in qs[by].values()) * sum(n for n, _, _ in xs[by].values()) for by in qs.keys() & xs.keys())
    if grid is None and sum(qs[by][c][0] * xs[by][d][0] for by, c, d, _ in kept) > (1 - PRUNED_SHARE) * total:
        return None
    rows = [(by, c, qs[by][c][2], d, splits) for by, c, d, splits in kept]
    return q, x, F.broadcast(x.sparkSession.createDataFrame(rows, _PAIRS))


_PAIRS = "by string, q_cell int, q_splits int, x_cell int, x_splits int"
_TILE = ("by", "q_cell", "q_split", "x_cell", "x_split")


def tile_rows(q: DataFrame, x: DataFrame, metric: Metric, max_dist: float | None = None, top_n: int | None = None,
              block_rows: int = BLOCK_ROWS, grid: int | None = None, mirror: bool = False, whole_rows: int | None = None,
              held_blocks: int = HELD_BLOCKS) -> DataFrame:
    """(by, q_cell, q_split, x_cell, x_split, side, q_id, x_id, tag, vec): every row once per tile that it belongs to.

    With ``mirror`` a pair of different parts makes one tile only.
    """
    cells = None
    if metric.triangle and (max_dist is not None or top_n is not None):
        cells = _in_cells(q, x, metric, max_dist, top_n, block_rows, grid)
    q, x, pairs = cells or _uncut(q, x, block_rows, grid, mirror, whole_rows, held_blocks)
    kinds = {"q": q.schema["id"].dataType, "x": x.schema["id"].dataType}

    def side(df: DataFrame, own: str, other: str, code: int) -> DataFrame:
        part = F.pmod(F.xxhash64("id"), F.col(f"{own}_splits")).cast("int")
        met = df.withColumnRenamed("cell", f"{own}_cell").join(pairs, ["by", f"{own}_cell"])
        first, last = F.lit(0), F.col(f"{other}_splits") - 1
        if mirror:
            first, last = (part, last) if own == "q" else (first, part)
        every = F.explode(F.sequence(first, last)).alias(f"{other}_split")
        ids = [(F.col("id") if s == own else F.lit(None).cast(kind)).alias(f"{s}_id") for s, kind in kinds.items()]
        return met.select("by", "q_cell", "x_cell", part.alias(f"{own}_split"), every, *ids, "tag", "vec").select(
            *_TILE, F.lit(code).alias("side"), "q_id", "x_id", "tag", "vec")

    return side(q, "q", "x", 0).unionByName(side(x, "x", "q", 1))


def _gridded(q, x, make, out, metric, max_dist, top_n, block_rows, grid, shared, whole_rows, held_blocks) -> DataFrame:
    mirror = shared and metric.triangle
    rows = tile_rows(q, x, metric, max_dist, top_n, block_rows, grid, mirror, whole_rows, held_blocks)
    dealt = rows.repartition(*_TILE).sortWithinPartitions(*_TILE, "side").select(
        F.concat_ws("|", *_TILE[1:], "by").alias("tile"), (F.col("q_split") == F.col("x_split")).alias("own"),
        "by", "side", "q_id", "x_id", "tag", "vec")

    def block(rows: pa.RecordBatch, side: str) -> Block:
        return Block(_flat(rows.column(f"{side}_id")), _matrix(rows.column("vec")), rows.column("tag").to_numpy())

    def run(batches):
        schema = _arrow_schema(out)
        tile, name, times, held = None, None, 1, []  # held: (block of queries, its reducer)
        common: dict[str, Reducer] = {}

        def finish():
            for _, reducer in held if not shared else ():
                for cols in reducer.rows():
                    yield from _emit(name, cols, schema)

        for batch in batches:
            runs = pc.run_end_encode(batch.column("tile"))
            start = 0
            for end, key in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                part, start = batch.slice(start, end - start), end
                if key != tile:
                    yield from finish()
                    tile, name, held = key, part.column("by")[0].as_py(), []
                    times = 2 if mirror and not part.column("own")[0].as_py() else 1
                n = int(np.searchsorted(part.column("side").to_numpy(), 1))
                for s in range(0, n, block_rows):
                    if shared and name not in common:
                        common[name] = make()
                    held.append((block(part.slice(s, min(block_rows, n - s)), "q"), common[name] if shared else make()))
                if n == part.num_rows or not held:
                    continue
                items = block(part.slice(n), "x")
                for queries, reducer in held:
                    _same_width(queries, items)
                    for cols in reducer.add(queries, items, times):
                        yield from _emit(name, cols, schema)
        yield from finish()
        for name, reducer in common.items():
            for cols in reducer.rows():
                yield from _emit(name, cols, schema)

    return dealt.mapInArrow(run, out)


# ---------------------------------------------------------------- ranked search


class Hits(Reducer):
    """(query, item, distance) of all pairs that ``where`` keeps of ``dist(q.mat, x.mat)``."""

    def __init__(self, dist: Callable[[np.ndarray, np.ndarray], np.ndarray], where=None):
        self.dist, self.where = dist, where

    def add(self, q, x, times):
        for part in slabs(q, x, TILE_CELLS):
            d = self.dist(q.mat, part.mat)
            if self.where is None:
                yield [np.repeat(q.ids, len(part.ids)), np.tile(part.ids, len(q.ids)), d.reshape(-1)]
                continue
            r, c = np.nonzero(self.where(d))
            if len(r):
                yield [q.ids[r], part.ids[c], d[r, c]]


class Nearest(Reducer):
    """The ``k`` best rows per query by (distance, item), or all under a limit, of the rounded distances that ``where`` keeps.

    Once k rows of a query are held, only items that can be nearer than its k-th are compared in full. With ``reach``, which gives the
    Euclidean distance that a result distance comes from, a matrix product in single precision tells them; its error is bounded.
    """

    def __init__(self, dist, k: int | None, where=None, limit: float = np.inf, reach=None):
        self.dist, self.k, self.where, self.limit, self.reach = dist, k, where, limit, reach
        self.cols: list[np.ndarray] | None = None
        self.fresh: list[list[np.ndarray]] = []
        self.waiting = 0
        self.side = self.bound = None

    def add(self, q, x, times):
        if self.bound is None:
            self.bound = np.full(len(q.ids), self.limit)
        start = 0
        while start < len(x.ids):
            seen = 0 if self.cols is None else self.seen
            # Until the bounds are tight, a run of items is a few times as long as all before.
            step = max(1, TILE_CELLS // max(1, len(q.ids)))
            if self.k is not None and self.reach is not None:
                step = min(step, max(64, 2 * self.k, 3 * seen))
            part = x.rows(slice(start, start + step))
            start += step
            cols = self._screened(q, part) if self.reach is not None else None
            cols = self._compared(q, part) if cols is None else cols
            if self.k is None:
                if len(cols[0]):
                    yield cols
                continue
            self.fresh.append(cols)
            self.waiting += len(cols[0])
            self.seen = seen + len(part.ids)
            if self.cols is None or self.waiting >= len(self.cols[0]) // 2:
                self._merge(q)

    def rows(self):
        if self.k is not None and (self.fresh or self.cols is not None):
            self._merge(None)
            yield self.cols

    def _compared(self, q, x):
        d = self.dist(q.mat, x.mat)
        keep = np.ones(d.shape, bool) if self.where is None else self.where(d)
        if self.k is not None and d.shape[1] > self.k:
            ranked = np.where(keep, d, np.inf)
            keep &= d <= np.partition(ranked, self.k - 1, axis=1)[:, self.k - 1 : self.k]
        r, c = np.nonzero(keep)
        return [q.ids[r], x.ids[c], d[r, c]]

    def _screened(self, q, x):
        """Pairs that pass a cheap test; None where it tells too little."""
        if not np.isfinite(self.bound).any():
            return None
        if self.side is None:
            qq = np.einsum("ij,ij->i", q.mat, q.mat)
            self.side = qq, np.c_[q.mat, np.ones(len(q.ids))].astype(np.float32)
        qq, mat = self.side
        xx = np.einsum("ij,ij->i", x.mat, x.mat)
        most = xx.max(initial=0.0)
        # x is near q where 2 q.x - x.x is large; rounding of the product is bounded by the sizes of both.
        if not (np.isfinite(qq).all() and max(most, qq.max(initial=0.0)) < 1e30):
            return None
        slack = (2 * q.mat.shape[1] + 16) * 2.0**-23 * (qq + most)
        need = (qq - self.reach(self.bound) ** 2 * (1 + 1e-9) - slack) / 2
        near = mat @ np.c_[x.mat, -xx / 2].astype(np.float32).T
        flat = np.flatnonzero(near >= np.nextafter(need.astype(np.float32), np.float32(-np.inf))[:, None])
        if len(flat) > SCREENED_SHARE * near.size and len(flat) > 4096:
            return None
        r, c = np.divmod(flat, near.shape[1])
        d = np.empty(len(r))
        for s in range(0, len(r), 1 << 14):
            a, b = r[s : s + (1 << 14)], c[s : s + (1 << 14)]
            gap = q.mat[a] - x.mat[b]
            d[s : s + (1 << 14)] = np.einsum("ij,ij->i", gap, gap)
        d = self.dist.finish(np.sqrt(d))
        keep = d <= self.bound[r]
        if self.where is not None:
            keep &= self.where(d)
        return [q.ids[r[keep]], x.ids[c[keep]], d[keep]]

    def _merge(self, q):
        parts = self.fresh if self.cols is None else [self.cols, *self.fresh]
        ids, items, d = (np.concatenate(cols) for cols in zip(*parts))
        self.fresh, self.waiting = [], 0
        order = np.lexsort((items, d, ids))
        ids = ids[order]
        first = np.r_[True, ids[1:] != ids[:-1]] if len(ids) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0)) if len(ids) else first
        keep = order[np.arange(len(ids)) - start < self.k]
        self.cols = [np.concatenate(c)[keep] for c in zip(*parts)]
        if q is None or self.reach is None or q.ids.dtype.kind not in "iuU" or not len(ids):
            return
        # The k-th distance of every query that has k rows.
        heads = np.flatnonzero(first)
        full = np.diff(np.r_[heads, len(ids)]) >= self.k
        at = np.searchsorted(ids[heads], q.ids)
        at = np.minimum(at, len(heads) - 1)
        known = (ids[heads][at] == q.ids) & full[at]
        kth = d[order[np.minimum(heads[at] + self.k - 1, len(ids) - 1)]]
        self.bound = np.where(known, np.minimum(kth, self.limit), self.limit)


class Rounded:
    """Distances of a metric, normalised when a scale is given, on ``digits`` decimals."""

    def __init__(self, metric: Metric, scale: float | None, digits: int):
        self.metric, self.scale, self.digits = metric, scale, digits

    def finish(self, d: np.ndarray) -> np.ndarray:
        if self.scale is not None:
            d = unit_values(d, self.scale)
        return np.round(d, self.digits) + 0.0

    def __call__(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.finish(self.metric.block(q, x))

    def reach(self, bound: np.ndarray) -> np.ndarray:
        """A distance that none under the rounded ``bound`` exceeds."""
        most = bound + 10.0**-self.digits
        if self.scale is None:
            return most
        with np.errstate(all="ignore"):
            return np.where(most < 1 - 1e-12, 2 / np.pi * np.tan(np.pi / 2 * np.minimum(most, 1.0)) / self.scale * (1 + 1e-9), np.inf)


def search(
    queries: DataFrame,
    items: DataFrame,
    metric: str | Metric = "l2",
    top_n: int | None = None,
    max_dist: float | None = None,
    skip: str | None = None,
    scale: float | None = None,
    digits: int = scalars.DIGITS,
    rank: bool | None = None,
    **layout,
) -> DataFrame:
    """Neighbours ``(by, query_id, item_id, dist[, rank])`` under top-N, radius, both or none.

    Top-N results carry their rank; an unbounded result only when ``rank`` asks for it.

    ``skip='id'`` drops the query's own id, ``skip='zero'`` every item at distance 0. With a
    ``scale`` distances come out as ``unit(scale * d)`` and ``max_dist`` is read in that space.
    """
    m = metric_of(metric)
    # Hits are tested on the rounded distance, so pruning allows for one unit of rounding.
    slack = None if max_dist is None else max_dist + 10.0**-digits
    if scale is None or slack is None:
        prune = slack
    else:
        prune = scalars.real_value(slack) / scale if slack < 1 else None
    k = None if top_n is None else top_n + (1 if skip == "id" else 0)
    limit = max_dist

    dist = Rounded(m, scale, digits)
    where = None
    if limit is not None or skip == "zero":
        def where(d: np.ndarray) -> np.ndarray:
            keep = np.ones(d.shape, bool) if limit is None else d <= limit
            return keep & (d > 0) if skip == "zero" else keep

    reach = dist.reach if m.block is _l2_block and (k is not None or limit is not None) else None

    def make() -> Reducer:
        if k is None and reach is None:
            return Hits(dist, where)
        return Nearest(dist, k, where, np.inf if limit is None else limit, reach)

    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("item_id", items.schema["item_id"].dataType),
            T.StructField("dist", T.DoubleType()),
        ]
    )
    hits = pair_reduce(queries, items, make, schema, m, prune, None if skip == "zero" else k, kept=k or 0, **layout)
    if skip == "id":
        hits = hits.filter(F.col("query_id") != F.col("item_id"))
    return ranked(hits, top_n) if rank or (rank is None and top_n is not None) else hits


def ranked(hits: DataFrame, top_n: int | None = None) -> DataFrame:
    """Ascending rank per query (and ``by``), ties by item id, optionally cut at top_n.

    With a bound each task keeps its best rows before the shuffle. Without one a single query may
    rank every item, so the rows are numbered across tasks.
    """
    keys = [c for c in ("by", "query_id") if c in hits.columns]
    if top_n is None:
        return numbered(cut(hits), keys, ["dist", "item_id"], "rank")
    w = Window.partitionBy(*keys).orderBy("dist", "item_id")
    out = hits.withColumn("rank", F.row_number().over(w).cast("bigint"))
    return out.filter(F.col("rank") <= top_n)


def search_penalised(
    queries: DataFrame, items: DataFrame, max_dist: float, metric: str | Metric = "l2",
    scale: float | None = None, **layout,
) -> DataFrame:
    """Radius search across kinds: a pair of different kinds counts at sqrt(dist).

    sqrt never lowers a distance in [0, 1], so the plain radius result holds every survivor.
    """
    q = queries.select("query_id", F.col("kind").alias("q_kind"))
    x = items.select("item_id", F.col("kind").alias("x_kind"))
    hits = search(queries, items, metric, max_dist=max_dist, scale=scale, **layout)
    d = scalars.rounded(scalars.penalise(F.col("dist"), F.col("q_kind") != F.col("x_kind")))
    return (
        hits.join(q, "query_id")
        .join(x, "item_id")
        .withColumn("dist", d)
        .filter(F.col("dist") <= max_dist)
        .drop("q_kind", "x_kind")
    )


def centroid(items: DataFrame) -> DataFrame:
    """One row ``(centre)``: the mean vector of the whole table."""
    return (
        items.select(F.posexplode(vectors.doubles(F.col("vec"))))
        .groupBy("pos")
        .agg(F.avg("col").alias("mean"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("m"))
        .select(F.transform("m", lambda e: e["mean"]).alias("centre"))
    )


def index_radius(items: DataFrame, metric: str | Metric = "l2") -> tuple[list[float], float]:
    """The mean vector and the largest distance from it."""
    centre = centroid(items).first()[0]
    d = metric_of(metric).expr(vectors.doubles(F.col("vec")), F.array(*map(F.lit, centre)))
    return centre, items.agg(F.max(d)).first()[0]


def pivot_radius(queries: DataFrame, items: DataFrame, radius: float,
                 metric: str | Metric = "l2", relative: bool = False, **layout) -> DataFrame:
    """Radius join pruned by rings around the data-set centre c.

    |d(q,c) - d(x,c)| <= r is necessary, so a query meets the rings next to its own only; a ring
    of any size is split by the block layout. ``relative`` reads the radius as a share of
    R + d(q,c) with R the index radius.
    """
    m = metric_of(metric)
    centre, reach = index_radius(items, m)
    c = F.array(*map(F.lit, centre))
    own = m.expr(vectors.doubles(F.col("vec")), c)
    q = queries.select("query_id", "vec", own.alias("own"))
    r = radius
    if relative:
        r = radius * (reach + (q.agg(F.max("own")).first()[0] or 0.0))
    width = max(r, 1e-9) * (1 + 1e-6) + 1e-6
    ring = F.floor(F.col("own") / width)
    rings = F.explode(F.sequence(F.greatest(ring - 1, F.lit(0)), ring + 1))
    x = items.select("item_id", "vec", own.alias("own")).withColumn("by", ring)
    hits = search(q.withColumn("by", rings), x, m, max_dist=r, **layout).drop("by")
    if relative:
        hits = (
            hits.join(q.select("query_id", "own"), "query_id")
            .filter(F.col("dist") <= radius * (F.lit(reach) + F.col("own")))
            .drop("own")
        )
    return hits


def search_exact(queries: DataFrame, items: DataFrame, value: str = "vec") -> DataFrame:
    """Pairs whose values are identical: an equi-join on a hash, verified on the value."""
    q = queries.select("query_id", F.col(value).alias("_q"), F.xxhash64(value).alias("_h"))
    x = items.select("item_id", F.col(value).alias("_x"), F.xxhash64(value).alias("_h"))
    return (
        q.join(x, "_h")
        .filter(F.col("_q") == F.col("_x"))
        .select("query_id", "item_id", F.lit(0.0).alias("dist"))
    )


def pair_distance(pairs: DataFrame, items: DataFrame, metric: str = "l2") -> DataFrame:
    """Distance of listed pairs ``(a_id, b_id)``; 1 when either side has no vector."""
    a = items.select(F.col("item_id").alias("a_id"), vectors.doubles(F.col("vec")).alias("_a"))
    b = items.select(F.col("item_id").alias("b_id"), vectors.doubles(F.col("vec")).alias("_b"))
    d = scalars.unit(metric_of(metric).expr(F.col("_a"), F.col("_b")))
    return (
        pairs.join(a, "a_id", "left")
        .join(b, "b_id", "left")
        .select("a_id", "b_id", scalars.rounded(F.coalesce(d, F.lit(1.0))).alias("dist"))
    )
