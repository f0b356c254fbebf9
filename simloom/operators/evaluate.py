"""Leave-one-out evaluation of neighbours against labels, and scoring of matched regions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simloom.functions.scalars import rounded
from simloom.operators import regions
from simloom.operators.region_cascade import cascade_totals
from simloom.operators.similarity import CHAIN_CELLS, TILE_CELLS, Metric, Reducer, metric_of, pair_reduce, slabs, unit_values
from simloom.session import cut

RADIUS_STEPS = tuple(round(0.1 * i, 1) for i in range(1, 10))
TOP_N_STEPS = (1, 3, 5, 10, 20, 40)
RESOLUTION = 6
"""Decimals kept of a distance in pair counts, as in searches: bounds a histogram of distances under 1 to 10^6 bins."""


def recall(match: Column, given: Column) -> Column:
    return F.when(given == 0, F.lit(1.0)).otherwise(match / given)


def precision(match: Column, found: Column) -> Column:
    return F.when(found == 0, F.lit(1.0)).otherwise(match / found)


def f_score(r: Column, p: Column, b: float = 1.0) -> Column:
    b2 = b * b
    top, low = (1 + b2) * r * p, r + b2 * p
    return F.when(top == 0, F.lit(0.0)).when(low == 0, F.lit(1.0)).otherwise(top / low)


def with_prf(counts: DataFrame, b: float = 1.0) -> DataFrame:
    """Add recall, precision, f, fn and fp to rows with match, found and given."""
    m, found, given = (F.col(c).cast("double") for c in ("match", "found", "given"))
    return (
        counts.withColumn("recall", recall(m, given))
        .withColumn("precision", precision(m, found))
        .withColumn("f", rounded(f_score(F.col("recall"), F.col("precision"), b)))
        .withColumn("recall", rounded(F.col("recall")))
        .withColumn("precision", rounded(F.col("precision")))
        .withColumn("fn", rounded(given - m))
        .withColumn("fp", rounded(found - m))
    )


def scored(hits: DataFrame, weight: str = "none", exclude_self: bool = True) -> DataFrame:
    """Score per hit: 1, 1 - dist, 1 - rank/n or 1/(rank + 1); rank counts the skipped self row."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("_n"))
    rank = F.col("rank") - 1
    score = {
        "none": F.lit(1.0),
        "distance": 1 - F.col("dist"),
        "rank": 1 - rank / F.col("_n"),
        "inverse": 1 / (rank + 1),
    }[weight]
    out = hits.join(n, "query_id").withColumn("score", score).drop("_n")
    return out.filter(F.col("query_id") != F.col("item_id")) if exclude_self else out


def per_query(scores: DataFrame, items: DataFrame, exclude_self: bool = True) -> DataFrame:
    """(query_id, match, found, given, hit, possible) for every item as a query."""
    labels = items.select("item_id", "label")
    sizes = labels.groupBy("label").agg(F.count("*").alias("_size"))
    met = scores.join(
        labels.select(F.col("item_id").alias("query_id"), F.col("label").alias("_q")), "query_id"
    ).join(labels, "item_id")
    same = F.col("_q") == F.col("label")
    sums = met.groupBy("query_id").agg(
        F.sum(F.when(same, F.col("score")).otherwise(0.0)).alias("match"),
        F.sum("score").alias("found"),
        F.min(F.when(same, F.struct("rank", "score"))).alias("_first"),
    )
    off = 1 if exclude_self else 0
    zero = F.lit(0.0)
    return (
        labels.withColumnRenamed("item_id", "query_id")
        .join(sums, "query_id", "left")
        .join(sizes, "label")
        .select(
            "query_id",
            F.coalesce("match", zero).alias("match"),
            F.coalesce("found", zero).alias("found"),
            (F.col("_size") - off).alias("given"),
            F.coalesce("_first.score", zero).alias("hit"),
            (F.col("_size") > off).cast("bigint").alias("possible"),
        )
    )


def totals(queries: DataFrame, *keys: str) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("match", "found", "given", "hit", "possible")]
    return queries.groupBy(*keys).agg(*sums)


def given_pairs(items: DataFrame) -> int:
    """Ordered same-label pairs of different items."""
    sizes = items.groupBy("label").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0] or 0


#: Bins of a histogram that lie in arrays; those far away from them are kept as a list.
DENSE_BINS = 1 << 22


class _Histogram(Reducer):
    """Pairs of different items with and without a common tag per bin of their distance."""

    def __init__(self, metric: Metric, scale: float | None, digits: int):
        self.metric, self.scale, self.step = metric, scale, 10**digits
        self.low = self.alike = self.all = None
        self.far: list[list[np.ndarray]] = []

    def add(self, q, x, times):
        for part in slabs(q, x, 4 * TILE_CELLS):
            bins = np.empty((len(q.ids), len(part.ids)), np.int64)
            at = 0
            for few in slabs(q, part, CHAIN_CELLS):
                d = self.metric.block(q.mat, few.mat)
                d = unit_values(d, self.scale) if self.scale is not None else d
                bins[:, at : at + len(few.ids)] = np.rint(d * self.step)
                at += len(few.ids)
            alike = q.tag[:, None] == part.tag[None, :]
            self._count(bins.reshape(-1), bins[alike], times)
            if len(np.intersect1d(q.ids, part.ids)):
                own = q.ids[:, None] == part.ids[None, :]
                self._count(bins[own], bins[own & alike], -times)
        return iter(())

    def _count(self, bins: np.ndarray, alike: np.ndarray, times: int) -> None:
        if not len(bins):
            return
        low, high = int(bins.min()), int(bins.max())
        if self.low is None:
            width = min(DENSE_BINS, 2 * (high - low) + (1 << 16))
            self.low = max(0, low - width // 4)
            self.alike, self.all = np.zeros(width, np.int64), np.zeros(width, np.int64)
        end = self.low + len(self.all)
        if low < self.low or high >= end:
            near = [(b >= self.low) & (b < end) for b in (bins, alike)]
            used, at = np.unique(bins[~near[0]], return_inverse=True)
            same = np.bincount(np.searchsorted(used, alike[~near[1]]), minlength=len(used))
            self.far.append([used, same * times, np.bincount(at, minlength=len(used)) * times])
            if len(self.far) > 16:
                self.far = [self._far()]
            bins, alike = bins[near[0]], alike[near[1]]
        for b, counts in ((bins, self.all), (alike, self.alike)):
            found = np.bincount(b - self.low) if len(b) else np.zeros(0, np.int64)
            counts[: len(found)] += found * times

    def _far(self) -> list[np.ndarray]:
        cols = [np.concatenate(c) for c in zip(*self.far)]
        used, at = np.unique(cols[0], return_inverse=True)
        out = [used]
        for c in cols[1:]:
            out.append(np.zeros(len(used), np.int64))
            np.add.at(out[-1], at, c)
        return out

    def rows(self):
        if self.low is not None:
            used = np.flatnonzero(self.all)
            yield [used + self.low, self.alike[used], self.all[used] - self.alike[used]]
        if self.far:
            bins, same, both = self._far()
            some = both > 0
            yield [bins[some], same[some], (both - same)[some]]


def pair_counts(items: DataFrame, metric: str = "l2", scale: float | None = 1.0,
                digits: int = RESOLUTION, **layout) -> DataFrame:
    """(bin, same, other): ordered pairs of different items per rounded distance.

    ``bin`` is the distance times 10^digits, normalised when a scale is given. Blocks are counted
    where they are compared, so what moves is at most one row per bin and task. Distances are symmetric, so two different parts of the
    table meet once and count twice.
    """
    m = metric_of(metric)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("bin", "same", "other")])
    tagged = items.select("item_id", "vec", F.col("label").alias("tag"))
    out = pair_reduce(tagged.withColumnRenamed("item_id", "query_id"), tagged, lambda: _Histogram(m, scale, digits), schema, m, shared=True, **layout)
    return out.groupBy("bin").agg(F.sum("same").alias("same"), F.sum("other").alias("other"))


def radius_sweep(counts: DataFrame, given: int, steps: tuple[float, ...] = RADIUS_STEPS,
                 digits: int = RESOLUTION) -> DataFrame:
    """(t, match, found, given) per radius from one table of pair counts."""
    at = F.explode(F.filter(F.array(*map(F.lit, steps)), lambda t: F.col("bin") <= F.rint(t * 10**digits)))
    met = counts.select("same", "other", at.alias("t"))
    none = counts.sparkSession.createDataFrame([(t,) for t in steps], "t double")
    sums = met.groupBy("t").agg(F.sum("same").alias("match"), F.sum(F.col("same") + F.col("other")).alias("found"))
    return none.join(sums, "t", "left").select(
        "t", F.coalesce("match", F.lit(0)).alias("match"), F.coalesce("found", F.lit(0)).alias("found"),
        F.lit(given).cast("bigint").alias("given"),
    )


def rank_counts(hits: DataFrame, items: DataFrame) -> DataFrame:
    """(rank, same, other) over all ranked lists (self left out)."""
    labels = items.select("item_id", "label")
    same = (F.col("_q") == F.col("label")).cast("bigint")
    return (
        hits.join(labels.select(F.col("item_id").alias("query_id"), F.col("label").alias("_q")), "query_id")
        .join(labels, "item_id")
        .groupBy("rank")
        .agg(F.sum(same).alias("same"), F.sum(1 - same).alias("other"))
    )


def top_n_sweep(counts: DataFrame, given: int, steps: tuple[int, ...] = TOP_N_STEPS) -> DataFrame:
    at = F.explode(F.filter(F.array(*map(F.lit, steps)), lambda n: F.col("rank") <= n))
    sums = counts.select("same", "other", at.alias("t")).groupBy("t")
    return sums.agg(F.sum("same").alias("match"), F.sum(F.col("same") + F.col("other")).alias("found")).select(
        F.col("t").cast("double").alias("t"), "match", "found", F.lit(given).cast("bigint").alias("given")
    )


REGION_KINDS = ("f", "p", "i", "n", "m")


def region_counts(given: DataFrame, found: DataFrame, sub_weight: float = 0.0, tol: float = 0.5,
                  min_dim: int = 8, kinds: tuple[str, ...] = REGION_KINDS) -> DataFrame:
    """(img, match, found, given) of a one-to-one matching; another kind earns ``sub_weight``."""
    g, f = (df.filter(F.col("kind").isin(*kinds)) for df in (given, found))
    return _counted(g, f, regions.one_to_one(regions.overlap_pairs(g, f, tol, min_dim).select("img", "given", "found", "same", "area")), sub_weight)


def _counted(g: DataFrame, f: DataFrame, met: DataFrame, sub_weight: float) -> DataFrame:
    match = met.groupBy("img").agg(
        F.sum(F.when(F.col("same"), F.lit(1.0)).otherwise(F.lit(sub_weight))).alias("match")
    )
    sizes = (
        g.select("img", F.lit(1).alias("g"), F.lit(0).alias("f"))
        .unionByName(f.select("img", F.lit(0).alias("g"), F.lit(1).alias("f")))
        .groupBy("img")
        .agg(F.sum("f").alias("found"), F.sum("g").alias("given"))
    )
    return sizes.join(match, "img", "left").select(
        "img", F.coalesce("match", F.lit(0.0)).alias("match"), "found", "given"
    )


#: Regions of an image whose pairs one batch works out.
IMAGE_ROWS = 2000


def region_counts_cascade(given: DataFrame, found: DataFrame, given_subs: DataFrame | Column, found_subs: DataFrame | Column,
                          sub_weight: float = 0.0, tol: float = 0.5, min_dim: int = 8) -> DataFrame:
    """Totals with sub-regions: those of matched pairs are matched in turn at tol' = sqrt(tol),
    those of unmatched regions only count. Sub tables carry the parent id and image coordinates.

    Children that follow from their region can be given as columns over (img, rid, kind, r): arrays of (rid, kind, r). Then only the
    regions move, once, and images of up to IMAGE_ROWS of them are matched where their rows meet.
    """
    if isinstance(given_subs, DataFrame):
        return _cascade_of_tables(given, found, given_subs, found_subs, sub_weight, tol, min_dim)
    columns = given_subs, found_subs
    sides = [df.select("img", "rid", "kind", "r") for df in (given, found)]
    both = sides[0].select("*", F.lit(0).alias("side")).unionByName(sides[1].select("*", F.lit(1).alias("side"))).filter("img IS NOT NULL")
    large = cut(both.groupBy("img").agg(F.count("*").alias("n")).filter(F.col("n") > IMAGE_ROWS).select("img"))
    whole = large.isEmpty()
    if not whole:
        both = both.join(large, "img", "left_anti")
    flat = [F.col(f"r.{k}").cast("bigint").alias(k) for k in "xywh"]
    rows = both.repartition("img").sortWithinPartitions("img", "side").select(
        "img", "side", F.col("rid").cast("bigint").alias("rid"), "kind", *flat,
        F.transform(F.when(F.col("side") == 0, columns[0]).otherwise(columns[1]), lambda s: F.struct(
            s["rid"].cast("bigint").alias("rid"), s["kind"].alias("kind"), *[s["r"][k].cast("bigint").alias(k) for k in "xywh"])).alias("subs"))

    def run(batches):
        yield from cascade_totals(batches, sub_weight, tol, min_dim, REGION_KINDS)

    earned = rows.mapInArrow(run, "top double, low double, more bigint").agg(F.sum("top"), F.sum("low"), F.sum("more")).first()
    top, low, more = (v or 0 for v in earned)
    of_kind = [F.coalesce(F.size(F.filter(subs, lambda s: s["kind"].isin(*REGION_KINDS))), F.lit(0)) for subs in columns]
    of_kind = [F.greatest(n, F.lit(0)) for n in of_kind]
    n = [df.agg(F.count("*"), F.coalesce(F.sum(kept), F.lit(0))).first() for df, kept in zip(sides, of_kind)]
    if not whole:
        few = [df.join(large, "img", "left_semi") for df in sides]
        subs = [df.select("img", F.col("rid").alias("parent"), F.explode(c).alias("s")).select("img", "parent", "s.rid", "s.kind", "s.r") for df, c in zip(few, columns)]
        more_top, more_low = _cascade_parts(*few, *subs, sub_weight, tol, min_dim)
        (top_of_large, _, _), (low_of_large, counted, _) = more_top.first(), more_low.first()
        kinds = F.col("kind").isin(*REGION_KINDS)
        top, low, more = top + (top_of_large or 0), low + (low_of_large or 0), more + (counted or 0) - subs[1].filter(kinds).count()
    sums = [(float(top), n[1][0], n[0][0]), (float(low), n[1][1] + more, n[0][1])]
    sums = [row if row[1] + row[2] else (None, None, None) for row in sums]
    both = given.sparkSession.createDataFrame(sums, "match double, found bigint, given bigint")
    return both.agg(*[F.sum(c).alias(c) for c in ("match", "found", "given")])


def _cascade_of_tables(*how) -> DataFrame:
    top, low = _cascade_parts(*how)
    return top.unionByName(low).agg(*[F.sum(c).alias(c) for c in ("match", "found", "given")])


def _cascade_parts(given: DataFrame, found: DataFrame, given_subs: DataFrame, found_subs: DataFrame,
                   sub_weight: float, tol: float, min_dim: int) -> tuple[DataFrame, DataFrame]:
    """Totals (match, found, given) of the regions and of their children."""
    slim = ("img", "given", "found", "same", "area")
    met = cut(regions.one_to_one(regions.overlap_pairs(given, found, tol, min_dim).select(*slim)).select(*slim[:4]))
    top = _sums(given.count(), found.count(), met, sub_weight)
    kinds = F.col("kind").isin(*REGION_KINDS)
    gs, fs = given_subs.filter(kinds), found_subs.filter(kinds)
    # A region of several pairs counts its children once for each.
    many = cut(met.groupBy("img", F.col("found").alias("parent")).agg(F.count("*").alias("_n")).filter("_n > 1"))
    more = 0 if many.isEmpty() else fs.join(many, ["img", "parent"]).agg(F.sum(F.col("_n") - 1)).first()[0] or 0
    # Only children of pairs can match.
    pair = met.select("img", F.col("found").alias("parent"), F.concat_ws(":", "img", "given").alias("_k"))
    owned = fs.join(pair, ["img", "parent"]).withColumn("img", F.col("_k")).drop("_k", "parent")
    asking = gs.withColumn("img", F.concat_ws(":", "img", "parent")).drop("parent")
    low_met = regions.one_to_one(regions.overlap_pairs(asking, owned, tol**0.5, min_dim).select(*slim))
    return top, _sums(gs.count(), fs.count() + more, low_met, sub_weight)


def _sums(given: int, found: int, met: DataFrame, sub_weight: float) -> DataFrame:
    """One row of the totals that ``_counted`` has per image; a sum of no images is NULL."""
    earned = F.coalesce(F.sum(F.when(F.col("same"), F.lit(1.0)).otherwise(F.lit(sub_weight))), F.lit(0.0))
    n = F.lit(given + found)
    return met.agg(*[F.when(n > 0, c).alias(name) for name, c in (
        ("match", earned), ("found", F.lit(found).cast("bigint")), ("given", F.lit(given).cast("bigint")))])


def report(per_item: DataFrame, which: str) -> DataFrame:
    """Items that are good (F = 1), bad (F < 1), or have misses (fn) or false alarms (fp)."""
    keep = {
        "good": F.col("f") == 1,
        "bad": F.col("f") < 1,
        "fn": F.col("recall") < 1,
        "fp": F.col("precision") < 1,
    }[which]
    return per_item.filter(keep)
