"""Approximate neighbours: bucket keys decide who meets, exact distances rank."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simloom.functions import vectors
from simloom.operators.similarity import _arrow_schema, _matrix, ranked, search

#: Items that should share a bucket or a cell, and items that cells are trained on, at most.
BUCKET_ROWS, CELL_ROWS, TRAIN_ROWS = 32, 64, 200_000
#: Share of the true neighbours that probes are widened to meet, measured on a few queries with about so many neighbours;
#: keys made at once; distances that take as long as dealing out one key.
RECALL, MEASURED_PAIRS, KEYS, KEY_ROWS = 0.93, 4096, 200_000, 1024


def _keyed(df: DataFrame, keys_of, setup, each: int = 1) -> DataFrame:
    """Add ``by``: one row per bucket key of the vector, ``each`` keys for a row."""
    ready = df.withColumn("vec", vectors.doubles(F.col("vec")))
    shared = df.sparkSession.sparkContext.broadcast(setup)
    schema = T.StructType([*ready.schema.fields, T.StructField("keys", T.ArrayType(T.StringType()))])

    def run(batches):
        arrow = _arrow_schema(schema)
        step = max(1, KEYS // each)
        for whole in batches:
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                keys = keys_of(_matrix(batch.column("vec")), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(keys, arrow.field("keys").type)], schema=arrow
                )

    return ready.mapInArrow(run, schema).withColumn("by", F.explode("keys")).drop("keys")


def _best(hits: DataFrame, top_n: int) -> DataFrame:
    once = hits.groupBy("query_id", "item_id").agg(F.min("dist").alias("dist"))
    return ranked(once, top_n)


def _true_pairs(queries: DataFrame, items: DataFrame, top_n: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a bounded number of queries and of their exact neighbours among all items, one pair a row."""
    few = max(16, min(512, MEASURED_PAIRS // max(top_n, 1)))
    some = queries.select("query_id", vectors.doubles(F.col("vec")).alias("vec")).filter("vec IS NOT NULL")
    asked = some.orderBy(F.xxhash64(F.col("query_id")), "query_id").limit(few)
    near = search(asked, items, top_n=top_n, skip="id").select("query_id", "item_id")
    near = near.join(F.broadcast(asked.withColumnRenamed("vec", "a")), "query_id")
    rows = items.select("item_id", vectors.doubles(F.col("vec")).alias("b")).join(F.broadcast(near), "item_id").select("a", "b").collect()
    return np.array([r["a"] for r in rows], float), np.array([r["b"] for r in rows], float)


def _enough(needed: np.ndarray, share: float = RECALL) -> int:
    """The least number that covers the wanted share of the needed ones."""
    return int(np.sort(needed)[math.ceil(share * len(needed)) - 1])


def lsh_neighbours(queries: DataFrame, items: DataFrame, top_n: int, tables: int = 48, planes: int | None = None,
                   seed: int = 7, unsure: int | None = None, **layout) -> DataFrame:
    """Signed random projections: ``tables`` keys of ``planes`` bits each.

    Planes follow from the item count, so that buckets keep their size as the table grows. In every table a query looks into
    all buckets that its ``unsure`` bits nearest to their planes leave open; by default as many as it takes to meet RECALL of
    the exact neighbours of a few queries. Where that costs as much as comparing all, all are compared. A bucket
    of any size is split into blocks by the join, and only top-n rows leave it.
    """
    dim = items.select(F.size("vec")).first()
    total = None
    if planes is None:
        total = items.count()
        planes = max(1, math.ceil(math.log2(max(total, 2) / BUCKET_ROWS)))
    if dim is None:
        return search(queries, items, top_n=top_n, skip="id").select("query_id", "item_id", "dist", "rank")
    normals = np.random.default_rng(seed).normal(size=(dim[0], tables * planes))
    if unsure is None:
        unsure = 0
        a, b = _true_pairs(queries, items, top_n)
        if len(a):
            needed = np.concatenate([_unsure_bits(a[i:i + 256], b[i:i + 256], normals, tables) for i in range(0, len(a), 256)])
            unsure = _enough(needed)
    keys = tables << unsure
    if unsure and keys >= 1 << planes or total is not None and keys * (KEY_ROWS + BUCKET_ROWS) >= total:
        return search(queries, items, top_n=top_n, skip="id", **layout).select("query_id", "item_id", "dist", "rank")

    def keys_of(open_bits: int):
        subsets = np.arange(1 << open_bits)[:, None] >> np.arange(open_bits) & 1

        def coded(mat: np.ndarray, n: np.ndarray) -> list[list[str]]:
            sides = (mat @ n).reshape(len(mat), tables, planes)
            codes = ((sides > 0) @ (1 << np.arange(planes)))[:, :, None]
            if open_bits:
                nearest = np.argsort(np.abs(sides), axis=2)[:, :, :open_bits]
                codes = codes ^ ((1 << nearest) @ subsets.T)
            return [[f"{t}:{c}" for t, some in enumerate(row) for c in some] for row in codes.tolist()]

        return coded

    hits = search(
        _keyed(queries, keys_of(unsure), normals, keys), _keyed(items, keys_of(0), normals, tables),
        top_n=top_n, skip="id", **layout
    )
    return _best(hits, top_n)


def _unsure_bits(a: np.ndarray, b: np.ndarray, normals: np.ndarray, tables: int) -> np.ndarray:
    """For each pair of vectors, how many of the first one's least sure bits have to be left open in the best table."""
    sides = (a @ normals).reshape(len(a), tables, -1)
    differ = (sides > 0) != ((b @ normals).reshape(sides.shape) > 0)
    order = np.argsort(np.abs(sides), axis=2)
    late = np.take_along_axis(differ, order, axis=2) * np.arange(1, sides.shape[2] + 1)
    return late.max(axis=2).min(axis=1)


def train_cells(items: DataFrame, cells: int | None = None, seed: int = 7) -> np.ndarray:
    """Coarse centroids: about the square root of the item count, so cells and items per cell grow alike.

    They are trained on a sample of at most about TRAIN_ROWS items; every item is put into a cell.
    """
    total = items.count()
    if cells is None:
        cells = max(1, min(math.ceil(total / CELL_ROWS), math.ceil(total**0.5)))
    data = items.select(array_to_vector(vectors.doubles(F.col("vec"))).alias("features"))
    if total > TRAIN_ROWS:
        data = data.sample(TRAIN_ROWS / total, seed)
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(data)
    return np.array(model.clusterCenters())


def cell_neighbours(queries: DataFrame, items: DataFrame, top_n: int, centres: np.ndarray | None = None,
                    probes: int | None = None, **layout) -> DataFrame:
    """Inverted file: an item lies in its nearest cell, a query probes its ``probes`` nearest.

    By default that number grows with the square root of the cells, and further until the exact neighbours of a few queries
    are met with RECALL. Where that costs as much as comparing all, all are compared.
    """
    total = None
    if centres is None:
        centres, total = train_cells(items), items.count()
    if probes is None:
        probes = min(len(centres), 8 + math.isqrt(len(centres)))
        a, b = _true_pairs(queries, items, top_n)
        if probes < len(centres) and len(a):
            needed = [_cell_ranks(a[i:i + 256], b[i:i + 256], centres) for i in range(0, len(a), 256)]
            probes = max(probes, _enough(np.concatenate(needed)))
    if probes >= len(centres) or total is not None and probes * (KEY_ROWS + total / len(centres)) >= total:
        return search(queries, items, top_n=top_n, skip="id", **layout).select("query_id", "item_id", "dist", "rank")

    def cells_of(count: int):
        def keys_of(mat: np.ndarray, c: np.ndarray) -> list[list[str]]:
            d = (c**2).sum(axis=1)[None, :] - 2 * mat @ c.T
            return [[str(j) for j in row] for row in np.argsort(d, axis=1)[:, :count]]

        return keys_of

    hits = search(
        _keyed(queries, cells_of(probes), centres, probes), _keyed(items, cells_of(1), centres),
        top_n=top_n, skip="id", **layout,
    )
    return _best(hits, top_n)


def _cell_ranks(a: np.ndarray, b: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each pair of vectors, how many of the first one's nearest cells it takes to meet the second one's cell."""
    far = (centres**2).sum(axis=1)[None, :]
    home = np.argmin(far - 2 * b @ centres.T, axis=1)
    order = np.argsort(far - 2 * a @ centres.T, axis=1)
    return 1 + np.argmax(order == home[:, None], axis=1)
