"""Filters and validation of items, requests, annotations and attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions import rects

# Result codes of a request, in order.
ERROR_CODES = (
    "SUCCESS", "NOT_AVAILABLE", "INVALID_KEY", "KEY_REQUIRED", "ILLEGAL_EVENT_ID",
    "EVENT_ID_NOT_FOUND", "CANNOT_DOWNLOAD_URL", "URL_IS_EMPTY", "URL_IS_NULL", "URL_BAD_SCHEME",
    "URL_IS_INVALID", "LOCAL_FILE_URL_NOT_ALLOWED", "NO_FACE_DETECTED", "ILLEGAL_INFLATE_PERCENTAGE",
    "REGIONS_PARAM_IS_NULL", "DISPLAY_REGS_PARAM_IS_NULL", "RESULT_PARAM_IS_NULL",
    "BAD_PERFORMANCE_VALUE", "EXCEPTION", "INTERNAL_ERROR", "UNKNOWN", "INVALID_REGIONS",
)
CODE = {name: n for n, name in enumerate(ERROR_CODES)}
SCHEMES = ("http", "https", "ftp", "file")


def keep_child_count(rows: DataFrame, parent: str, order: list[str], least: int, most: int) -> DataFrame:
    """Rows of parents with at least ``least`` children, at most ``most`` of each in order."""
    sizes = rows.groupBy(parent).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(parent)
    w = Window.partitionBy(parent).orderBy(*order)
    first = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")
    return first.join(sizes, parent, "left_semi")


def size_ok(r: Column, min_diameter: int, min_aspect: float) -> Column:
    return (rects.diameter(r) >= min_diameter) & (rects.aspect_unit(r) >= min_aspect)


def request_code(key: Column, valid_key: Column, event_id: Column, url: Column, ingest: bool = True) -> Column:
    """Code of the first check a request fails, 0 when it passes."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.try_parse_url(url, F.lit("HOST"))

    def code(name: str) -> Column:
        return F.lit(CODE[name]).cast("bigint")

    out = (
        F.when(F.coalesce(key, F.lit("")) == "", code("KEY_REQUIRED"))
        .when(~F.coalesce(valid_key, F.lit(False)), code("INVALID_KEY"))
        .when(F.coalesce(event_id, F.lit(-1)) == -1, code("ILLEGAL_EVENT_ID"))
        .when(url.isNull(), code("URL_IS_NULL"))
        .when(F.trim(url) == "", code("URL_IS_EMPTY"))
        .when((scheme == "") | ~scheme.isin(*SCHEMES), code("URL_BAD_SCHEME"))
    )
    if ingest:
        out = out.when(scheme == "file", code("LOCAL_FILE_URL_NOT_ALLOWED"))
    return out.when((scheme != "file") & host.isNull(), code("URL_IS_INVALID")).otherwise(code("SUCCESS"))


def regions_ok(line: Column, regions: Column) -> Column:
    """No negative offset, no empty size, and no region after a blank instead of a TAB."""
    fine = F.forall(regions, lambda r: (r["x"] >= 0) & (r["y"] >= 0) & (r["w"] > 0) & (r["h"] > 0))
    return fine & ~line.rlike(r" [a-z]\{?\[")


def balanced(text: Column) -> Column:
    """Brackets of an annotation close in order and groups do not nest.

    The fold keeps the depth; -100 marks a group that opens inside another or closes too late.
    """
    marks = F.split(F.regexp_replace(text, r"[^{}\[\]]", ""), "")
    bad = F.lit(-100)

    def step(depth: Column, c: Column) -> Column:
        return (
            F.when(depth <= bad, bad)
            .when(c == "{", F.when(depth == 0, F.lit(1)).otherwise(bad))
            .when(c == "[", depth + 1)
            .when(c == "]", depth - 1)
            .when(c == "}", F.when(depth == 1, F.lit(0)).otherwise(bad))
            .otherwise(depth)
        )

    return F.aggregate(marks, F.lit(0), step) > bad


def within_limits(parts: DataFrame, group: str, kind: str = "kind", limits: dict[str, int] | None = None,
                  landmark_kinds: tuple[str, ...] = ("i", "n", "e", "m"), max_landmarks: int = 6,
                  primary_kinds: tuple[str, ...] = ("f", "p"), max_primary: int = 1) -> DataFrame:
    """Parts of groups that keep all limits; one violation voids the whole group."""
    k = F.col(kind)
    broken = (F.count_if(k.isin(*primary_kinds)) > max_primary) | (F.count_if(k.isin(*landmark_kinds)) > max_landmarks)
    for name, most in (limits or {}).items():
        broken = broken | (F.count_if(k == name) > most)
    bad = parts.groupBy(group).agg(broken.alias("_bad")).filter("_bad").select(group)
    return parts.join(bad, group, "left_anti")


def vocabulary_errors(attrs: DataFrame, vocab: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(item_id, code, problem) of attributes that break the vocabulary.

    ``attrs`` (item_id, code, value), ``vocab`` (code, value, max_n; negative = no limit),
    ``exclusions`` (code, a, b). Pairs are looked up through the exclusion list, so an item's
    values never meet each other.
    """
    once = attrs.select("item_id", "code", "value").distinct()
    unknown = once.join(vocab.select("code", "value"), ["code", "value"], "left_anti").select(
        "item_id", "code", F.lit("unknown value").alias("problem")
    )
    most = vocab.groupBy("code").agg(F.max("max_n").alias("_m"))
    many = (
        attrs.groupBy("item_id", "code").agg(F.count("*").alias("_n"))
        .join(most, "code")
        .filter((F.col("_m") >= 0) & (F.col("_n") > F.col("_m")))
        .select("item_id", "code", F.lit("too many").alias("problem"))
    )
    first = once.join(exclusions.select("code", F.col("a").alias("value"), "b"), ["code", "value"])
    clash = first.select("item_id", "code", F.col("b").alias("value")).join(
        once, ["item_id", "code", "value"], "left_semi"
    ).select("item_id", "code", F.lit("excluded pair").alias("problem"))
    return unknown.unionByName(many).unionByName(clash).distinct()


def normalise_annotations(lines: DataFrame, key: str = "line_no", text: str = "line") -> DataFrame:
    """Old ``id TAB f[..]`` and mixed lines as groups ``f{[..] TAB d[id]}``, one row per group.

    A group without its own ``d[..]`` takes the line's id; a line that is only an id stays as it is.
    """
    t = F.col(text)
    first = F.substring_index(t, "\t", 1)
    has_id = ~first.contains("[") & (first != "")
    line_id = F.when(has_id, first).otherwise(F.lit(""))
    tagged = F.concat(F.lit("\td["), F.col("_id"), F.lit("]}"))
    groups = F.regexp_extract_all(t, F.lit(r"([fp]\{\[[^}]*\})|(?:^|\t)([fp]\[[^\]]*\])(?=\t|$)"), 0)

    def clean(g: Column) -> Column:
        body = F.btrim(g, F.lit("\t"))
        old = body.rlike(r"^[fp]\[")
        grouped = F.when(old, F.concat(F.substring(body, 1, 1), F.lit("{"), F.substring(body, F.lit(2), F.length(body))))
        whole = F.coalesce(grouped, body)
        return (
            F.when(old & (F.col("_id") == ""), F.lit(None))
            .when(old, F.concat(whole, tagged))
            .when(whole.contains("d[") | (F.col("_id") == ""), whole)
            .otherwise(F.concat(F.substring(whole, F.lit(1), F.length(whole) - 1), tagged))
        )

    out = F.when(has_id & ~t.contains("\t"), F.array(first)).otherwise(
        F.filter(F.transform(F.col("_g"), clean), lambda g: g.isNotNull())
    )
    return (
        lines.withColumn("_id", line_id)
        .withColumn("_g", groups)
        .select(key, F.posexplode(out).alias("pos", "region_group"))
        .select(key, F.col("pos").cast("bigint").alias("pos"), "region_group")
    )
