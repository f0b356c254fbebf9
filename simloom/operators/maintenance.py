"""Item table upkeep: every operation returns the new version as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.functions import strings


def upsert(items: DataFrame, fresh: DataFrame, key: str = "item_id") -> DataFrame:
    """Insert or replace by id. ``seq`` orders both sides; the latest row of an id stands."""
    both = items.unionByName(fresh)
    rest = [c for c in both.columns if c != key]
    latest = F.max_by(F.struct(*rest), "seq").alias("_row")
    return both.groupBy(key).agg(latest).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def upsert_missing(items: DataFrame, fresh: DataFrame, key: str = "item_id") -> DataFrame:
    """Insert only the ids that are not there yet."""
    return items.unionByName(fresh.join(items.select(key), key, "left_anti"))


def replace_ids(items: DataFrame, fresh: DataFrame, key: str = "item_id", exempt: Column | None = None
                ) -> DataFrame:
    """Earlier rows of an arriving id go first; rows under ``exempt`` stay beside the new ones."""
    ids = fresh.select(key).distinct()
    if exempt is None:
        return items.join(ids, key, "left_anti").unionByName(fresh)
    stay = F.coalesce(exempt, F.lit(False))
    kept = items.filter(stay)
    return kept.unionByName(items.filter(~stay).join(ids, key, "left_anti")).unionByName(fresh)


def matching(items: DataFrame, needles: DataFrame, key: str = "item_id", exhaustive: bool = False
             ) -> DataFrame:
    """Ids that a needle names: exactly, else by label, file name or path.

    All of these are one equi-join. The exhaustive search, for needles that are no id themselves,
    joins the places where an id may start matching instead of comparing all ids with all needles.
    """
    path = strings.file_path(F.col(key))
    label = F.col("label") if "label" in items.columns else strings.derive_label(F.col(key))
    names = F.array(F.col(key), label, strings.file_name(path), path)
    keyed = items.select(key, F.posexplode(F.transform(names, lambda n: n.cast("string"))).alias("stage", "needle"))
    asked = needles.select("needle").distinct()
    hits = asked.join(keyed, "needle")
    exact = hits.filter("stage = 0").select("needle").distinct()
    out = hits.filter("stage = 0").select("needle", key).unionByName(
        hits.join(exact, "needle", "left_anti").select("needle", key)
    )
    if exhaustive:
        out = out.unionByName(_starting_at_part(items, asked.join(exact, "needle", "left_anti"), key))
    return out.distinct()


def _starting_at_part(items: DataFrame, needles: DataFrame, key: str) -> DataFrame:
    """Ids whose last occurrence of the needle opens the id or follows one of [ / \\ and dot.

    Needles fall into classes by the power of two in their length. Suffixes that start at such a place are
    joined, once per class, on as many characters as its needles have at least, and then checked whole; a
    short needle does not shorten the key of the others. An empty needle names nothing.
    """
    keyed = needles.withColumn("_size", _class_length(F.length("needle"))).withColumn(
        "_stem", F.expr("substring(needle, 1, _size)"))
    sizes = sorted(r[0] for r in keyed.filter("needle <> ''").select("_size").distinct().collect())  # at most 31
    text = F.col(key)
    if not sizes:
        return items.limit(0).select(F.lit("").alias("needle"), key)
    opens = F.filter(
        F.sequence(F.lit(1), F.greatest(F.length(text) - sizes[0] + 1, F.lit(1))),
        lambda i: (i == 1) | F.substring(text, i - 1, F.lit(1)).isin("[", "/", "\\", "."),
    )
    parts = items.select(key, F.explode(opens).alias("_i")).select(
        key, "_i", F.explode(F.array(*map(F.lit, sizes))).alias("_size")
    ).filter(F.length(text) - F.col("_i") + 1 >= F.col("_size")).withColumn(
        "_stem", F.substring(text, F.col("_i"), F.col("_size"))
    )
    return parts.join(keyed, ["_size", "_stem"]).filter(
        F.startswith(F.substring(text, F.col("_i"), F.length(text)), F.col("needle"))
        & (_last_start(text, F.col("needle")) == F.col("_i"))
    ).select("needle", key)


def _class_length(size: Column) -> Column:
    """Largest power of two that is not above a length."""
    return F.pow(F.lit(2), F.floor(F.log2(size))).cast("int")


def _last_start(text: Column, needle: Column) -> Column:
    """1-based start of the last occurrence of the needle."""
    back = F.instr(F.reverse(text), F.reverse(needle))
    return F.length(text) - back - F.length(needle) + 2


def list_items(items: DataFrame, pattern: str, key: str = "item_id") -> DataFrame:
    """List mini-language: empty = count, * = all, @ / groups / labels = group sizes, # / ! / cnt /
    count p = only the count of what p lists, else a needle. Output: (name, n)."""
    p = pattern.strip()
    if p in ("", "#", "!", "cnt", "count"):
        return items.agg(F.count("*").alias("n")).select(F.lit("count").alias("name"), "n")
    if p in ("@", "groups", "labels"):
        return items.groupBy(F.col("label").cast("string").alias("name")).agg(F.count("*").alias("n"))
    head, _, rest = p.partition(" ")
    if head in ("#", "!", "cnt", "count") and rest:
        return list_items(items, rest, key).agg(F.count("*").alias("n")).select(F.lit("count").alias("name"), "n")
    if p == "*":
        return items.select(F.col(key).cast("string").alias("name"), F.lit(1).cast("bigint").alias("n"))
    needle = items.sparkSession.createDataFrame([(p,)], "needle string")
    hits = matching(items, needle, key, exhaustive=True)
    return hits.select(F.col(key).cast("string").alias("name"), F.lit(1).cast("bigint").alias("n"))


def remove_listed(items: DataFrame, needles: DataFrame, key: str = "item_id", exhaustive: bool = False
                  ) -> DataFrame:
    gone = matching(items, needles, key, exhaustive).select(key).distinct()
    return items.join(gone, key, "left_anti")


def split_needles(requests: DataFrame, column: str, separator: str = "\n") -> DataFrame:
    """Needles of a removal request: parts between the separators, blanks dropped."""
    quoted = "\\Q" + separator + "\\E"
    return (
        requests.select(F.explode(F.split(column, quoted)).alias("needle"))
        .withColumn("needle", F.trim("needle"))
        .filter(F.col("needle") != "")
    )


def drop_collection(items: DataFrame, app: str, event_id: int) -> DataFrame:
    return items.filter(~((F.col("app") == app) & (F.col("event_id") == event_id)))


def index_difference(a: DataFrame, b: DataFrame, key: str = "item_id", value: str = "vec") -> DataFrame:
    """Ids that make two tables differ: missing on one side or holding another value."""
    x = a.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    y = b.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    why = (
        F.when(F.col("_in_b").isNull(), "only_first")
        .when(F.col("_in_a").isNull(), "only_second")
        .when(~F.col("_a").eqNullSafe(F.col("_b")), "value")
    )
    return x.join(y, key, "full").select(key, why.alias("difference")).filter("difference IS NOT NULL")


def variants(items: DataFrame, table: list[tuple[str, Column]], key: str = "item_id") -> DataFrame:
    """Each item with its variants under suffixed ids; the label is shared."""
    entries = F.array(*[F.struct(F.lit(name).alias("variant"), v.alias("vec")) for name, v in table])
    return items.select(key, "label", F.explode(entries).alias("_v")).select(
        F.concat(F.col(key).cast("string"), F.lit("/"), F.col("_v.variant")).alias(key),
        F.col("_v.variant").alias("variant"),
        "label",
        F.col("_v.vec").alias("vec"),
    )


def to_wide(long: DataFrame, types: list[str], key: str = "item_id") -> DataFrame:
    return long.groupBy(key).pivot("by", types).agg(F.first("vec"))


def to_long(wide: DataFrame, types: list[str], key: str = "item_id") -> DataFrame:
    """One row per descriptor; empty ones are left out."""
    entries = F.array(*[F.struct(F.lit(t).alias("by"), F.col(t).alias("vec")) for t in types])
    return wide.select(key, F.explode(entries).alias("_e")).select(key, "_e.by", "_e.vec").filter(
        F.size("vec") > 0
    )


def register_collections(known: DataFrame, requests: DataFrame) -> DataFrame:
    """Collections appear with their first ingest; a known one keeps its settings."""
    fresh = requests.groupBy("app", "event_id").agg(F.lit(0).alias("perf"))
    return known.unionByName(fresh.join(known, ["app", "event_id"], "left_anti"))


def set_performance(known: DataFrame, changes: DataFrame) -> DataFrame:
    """New performance levels (0, 1 or 2) for known collections; other levels are ignored."""
    ok = changes.filter(F.col("perf").isin(0, 1, 2)).groupBy("app", "event_id").agg(
        F.max_by("perf", "seq").alias("_new")
    )
    return known.join(ok, ["app", "event_id"], "left").select(
        "app", "event_id", F.coalesce("_new", "perf").alias("perf")
    )
