"""The supplied tables in the shapes the operators take, with the matching SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.functions import rects, vectors
from simloom.plans.catalogue import table

SLICES = ("s1", "s2", "s3", "s4")
SLICE_WEIGHTS = (0.1, 0.3, 0.6, 0.9)


def items(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.col("label").cast("bigint").alias("label"),
        vectors.doubles(F.col("embedding")).alias("vec"),
    )


def as_queries(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("item_id", "query_id")


def centroids(spark, sf) -> DataFrame:
    """One query per label: the mean vector of its items (components kept to 9 decimals)."""
    return (
        items(spark, sf)
        .select("label", F.posexplode("vec"))
        .groupBy("label", "pos")
        .agg(F.round(F.avg("col"), 9).alias("mean"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("m"))
        .select(
            F.col("label").alias("query_id"), F.transform("m", lambda e: e["mean"]).alias("vec")
        )
    )


def slices(spark, sf) -> DataFrame:
    """Four descriptors per item: consecutive runs of 16 values, one row each."""
    return items(spark, sf).select(
        "item_id",
        "label",
        F.posexplode(F.array(*[F.slice("vec", 1 + 16 * i, 16) for i in range(4)])).alias("i", "vec"),
    ).select(
        "item_id", "label", F.concat(F.lit("s"), (F.col("i") + 1).cast("string")).alias("by"), "vec"
    )


def boxes(spark, sf) -> DataFrame:
    """Rectangles of an image (an order), from integer columns of its lines."""
    q = F.col("l_quantity").cast("int")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("img"),
        ((F.col("l_linenumber").cast("bigint") * F.lit(10**9) + F.col("l_partkey")) * F.lit(10**6)
         + F.col("l_suppkey")).cast("bigint").alias("rid"),
        F.when(F.col("l_returnflag") == "R", "p").otherwise("f").alias("kind"),
        F.col("l_linestatus").alias("status"),
        rects.rect(
            (F.col("l_partkey") % 200).cast("int"),
            (F.col("l_suppkey") % 100).cast("int"),
            (q + 8).cast("int"),
            (q % 17 + 8).cast("int"),
        ).alias("r"),
    )


def flat(df: DataFrame, *keys: str, r: str = "r") -> DataFrame:
    """Rectangle column as four plain ones."""
    return df.select(*keys, *[F.col(f"{r}.{k}").cast("bigint").alias(k) for k in "xywh"])


E = (
    "e AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, "
    "list_transform(embedding, lambda t: CAST(t AS DOUBLE)) AS v FROM embeddings)"
)

CENTROIDS = (
    E + ", cm AS (SELECT label, g.pos AS pos, round(avg(v[g.pos]), 9) AS m FROM e, "
    "(SELECT unnest(range(1, 65)) AS pos) g GROUP BY ALL), "
    "c AS (SELECT label AS id, list(m ORDER BY pos) AS v FROM cm GROUP BY label)"
)

SLICED = (
    E + ", s AS (SELECT id, label, 's' || g.i AS dt, v[(g.i - 1) * 16 + 1 : g.i * 16] AS v "
    "FROM e, (SELECT unnest(range(1, 5)) AS i) g)"
)

BOXES = (
    "b AS (SELECT l_orderkey AS img, "
    "CAST((CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) * 1000000 + l_suppkey AS BIGINT) AS rid, "
    "CASE WHEN l_returnflag = 'R' THEN 'p' ELSE 'f' END AS kind, l_linestatus AS status, "
    "CAST(l_partkey % 200 AS BIGINT) AS x, CAST(l_suppkey % 100 AS BIGINT) AS y, "
    "CAST(l_quantity AS BIGINT) + 8 AS w, CAST(l_quantity AS BIGINT) % 17 + 8 AS h FROM lineitem)"
)

OVERLAP = (
    "(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * "
    "greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"
)


def overlap(a: str, b: str) -> str:
    return OVERLAP.format(a=a, b=b)


def iou(a: str, b: str) -> str:
    c = overlap(a, b)
    return f"({c} / ({a}.w * {a}.h + {b}.w * {b}.h - {c}))"


def unit(x: str) -> str:
    return f"(2 / pi() * atan(pi() / 2 * ({x})))"


def real(x: str) -> str:
    return f"(2 / pi() * tan(pi() / 2 * ({x})))"


def unit01(x: str) -> str:
    return f"(0.5 + atan({x}) / pi())"


def neighbours(k: int, self_too: bool = False) -> str:
    """CTE ``n``: k nearest of every item by rounded distance, ties by id."""
    cond = "true" if self_too else "a.id <> b.id"
    return (
        E.replace("e AS (", "e AS MATERIALIZED (", 1)
        + ", pd AS (SELECT a.id AS qid, b.id AS iid, a.label AS ql, b.label AS il, "
        f"round(list_distance(a.v, b.v), 6) AS d FROM e a, e b WHERE {cond}), "
        f"n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, iid) AS r FROM pd QUALIFY r <= {k})"
    )


def centroid_hits() -> str:
    """CTE ``h``: every item ranked for every label centroid."""
    return (
        CENTROIDS + ", h AS (SELECT c.id AS qid, e.id AS iid, e.label AS il, "
        "round(list_distance(c.v, e.v), 6) AS d FROM c, e)"
    )
