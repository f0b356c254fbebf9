"""Mixing sources to target weights by weighted fair queueing.

Every source shuffles its documents and puts them in a queue, as many passes as a document may be taken. A document's
virtual finish time is the source's words up to and including it divided by the source's target. All queues are
range-sorted by finish time and cut where the budget is spent, so sources run dry in step with their targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simloom.llm.columns import row_hash, staged, whole, word_count
from simloom.operators.prefix import running

WEIGHTS, BUDGET, PASSES = (3.0, 1.0, 2.0), 1.5, 2
#: Documents of a source that one task orders: a queue is cut into ranges of the shuffle key of about this many.
RANGE_ROWS = 4096


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET,
            passes: int = PASSES) -> DataFrame:
    """(source, source_size, n, sid, target) from one row (source, source_size, n) per source.

    Sources in code point order, NULL last, take the weights in turn. They share ``budget`` times all words by
    weight; none gets over ``passes`` times its own words, and what it leaves is shared again by weight. That is a
    common water level: target = min(cap, level * weight).
    """
    ranked = running(sizes.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], sid=("count", None))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size").cast("double") * passes)
    ranked = staged(ranked.withColumn("_ratio", F.col("_cap") / F.col("_w")), "sources")
    whole = ranked.agg(F.sum("source_size"), F.sum("_w")).first()
    share = (whole[0] or 0) * budget
    filled = running(ranked, [], ["_ratio", "sid"], _caps=("sum", F.col("_cap")), _ws=("sum", F.col("_w")))
    left = F.lit(float(share)) - (F.col("_caps") - F.col("_cap"))
    level = left / (F.lit(float(whole[1] or 0.0)) - (F.col("_ws") - F.col("_w")))
    filled = staged(filled.withColumn("_level", level), "levels")
    # The first source that is not filled up sees the level; all after it would see a lower one.
    free = filled.filter("_level < _ratio").agg(F.max("_level")).first()[0]
    target = F.col("_cap") if free is None else F.least(F.col("_cap"), F.lit(float(free)) * F.col("_w"))
    return filled.select("source", "source_size", "n", "sid", target.alias("target"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = "mix",
        weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, passes: int = PASSES) -> DataFrame:
    """(key, source, size, source_size, target, taken, copies, _row_hash): one row per input row.

    ``copies`` says how often the mix takes the document (0 to ``passes``), ``taken`` = copies * size. The order of a
    source depends on the seed and the keys alone, so reruns agree. Texts without words and NULL texts have size 0
    and are never taken. Rows that agree in everything are interchangeable. NULL is a source of its own. An empty
    table, or one without any word, mixes nothing.
    """
    sized = staged(
        docs.select(
            F.col(key).alias("_key"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
            F.md5(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("_u"),
            row_hash(docs).alias("_row_hash"),
        ).withColumn("_row", F.monotonically_increasing_id()),
        "sized",
    )
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goals = staged(targets(by_source, weights, budget, passes), "targets")
    share = (goals.agg(F.sum("source_size")).first()[0] or 0) * budget
    ranges = F.ceil(F.col("n") / RANGE_ROWS)
    first = F.conv(F.substring("_u", 1, 8), 16, 10).cast("bigint")
    met = sized.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    met = met.withColumn("_range", F.shiftright(first * ranges, 32))
    sums = met.groupBy("sid", "_range").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("sid").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("sid", "_range", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("sid", "_range").orderBy("_u", "_key", "_row_hash", "_row").rowsBetween(
        Window.unboundedPreceding, 0)
    queued = (
        met.filter("size > 0").join(before, ["sid", "_range"])
        .withColumn("_through", F.col("_before") + F.sum("size").over(inside))
        .withColumn("_pass", F.explode(F.array(*[F.lit(i) for i in range(passes)])))
        .select("_row", "_u", "_key", "_row_hash", "_pass", "size",
                ((F.col("_pass") * F.col("source_size") + F.col("_through")) / F.col("target")).alias("finish"))
    )
    order = ["finish", "_u", "_key", "_row_hash", "_row", "_pass"]
    served = running(queued, [], order, _spent=("sum", F.col("size"))).filter(F.col("_spent") <= F.lit(float(share)))
    copies = served.groupBy("_row").agg(F.count("*").alias("copies"))
    return (
        met.join(copies, "_row", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
        .select(F.col("_key").alias(key), "source", "size", "source_size", "target",
                (F.col("copies") * F.col("size")).alias("taken"), "copies", "_row_hash")
    )


def mixed(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with the columns of ``docs``.

    Rows that agree in every column are one document with several copies.
    """
    takes = mix(docs, text, key, source, **how).groupBy("_row_hash").agg(F.sum("copies").alias("_copies")).filter("_copies > 0")
    rows = docs.select(whole(docs).alias("doc"), row_hash(docs).alias("_row_hash")).dropDuplicates(["_row_hash"])
    times = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_i")
    return rows.join(takes, "_row_hash").select("doc", times).select("doc.*")
