"""Text sources: annotated lists, regions, manifests, key=value files, sparse cubes, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECT = r"\[(-?\d+),(-?\d+);(-?\d+),(-?\d+)\]"


def _plain(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.btrim("value", F.lit(" \t\r\n")).alias("line"))


def scan_list(spark: SparkSession, path: str, keep_comments: bool = False, top: int | None = None) -> DataFrame:
    """Lines of an annotated list: (file, line), blanks and (unless kept) comments skipped.

    ``top`` takes the first lines in file order: by path, split and place in the split.
    """
    raw = spark.read.text(path).select(
        F.btrim("value", F.lit(" \t\r\n")).alias("line"), F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    lines = raw.filter(F.col("line") != "")
    if not keep_comments:
        lines = lines.filter(~F.col("line").startswith("#"))
    if top is not None:
        lines = lines.orderBy("_path", "_start", "_at").limit(top)
    return lines.select(F.substring_index("line", "\t", 1).alias("file"), "line")


def _box(text: Column) -> Column:
    return F.struct(*[F.regexp_extract(text, RECT, n + 1).try_cast("int").alias(k) for n, k in enumerate("xywh")])


def parse_regions(lines: DataFrame, text: str = "line") -> DataFrame:
    """One row per region: kind, rectangle, sub-regions, attributes; ``ok`` is false for a region
    whose rectangle cannot be read."""
    top = F.regexp_extract_all(F.col(text), F.lit(r"(?:^|\t)([a-z]\{[^}]*\}|[a-z]\[[^\]]*\])"), 1)
    out = lines.select(*lines.columns, F.posexplode(top).alias("region_no", "region"))
    body = F.regexp_replace("region", r"^[a-z]\{?\[[^\]]*\]", "")
    subs = F.transform(
        F.regexp_extract_all(body, F.lit(r"([a-z]" + RECT + ")"), 1),
        lambda s: F.struct(F.substring(s, 1, 1).alias("kind"), _box(s).alias("r")),
    )
    attrs = F.transform(
        F.regexp_extract_all(body, F.lit(r"([a-z]\[[^\],;]*\])"), 1),
        lambda s: F.struct(F.substring(s, 1, 1).alias("kind"), F.regexp_extract(s, r"\[(.*)\]", 1).alias("value")),
    )
    return (
        out.withColumn("kind", F.substring("region", 1, 1))
        .withColumn("r", _box(F.regexp_extract("region", r"^[a-z]\{?(\[[^\]]*\])", 1)))
        .withColumn("subs", subs)
        .withColumn("attrs", attrs)
        .withColumn("ok", F.col("r.x").isNotNull() & F.col("r.h").isNotNull())
    )


def parse_manifest(lines: DataFrame, text: str = "line") -> DataFrame:
    """(dtype, file, weight) of manifest lines; NULL as file means none, the weight defaults to 1."""
    f = F.split(F.btrim(text, F.lit(" \t\r\n")), r"\s+")
    return lines.filter((F.trim(text) != "") & ~F.col(text).startswith("#")).select(
        f[0].alias("dtype"),
        F.nullif(F.try_element_at(f, F.lit(2)), F.lit("NULL")).alias("file"),
        F.coalesce(F.try_element_at(f, F.lit(3)).try_cast("double"), F.lit(1.0)).alias("weight"),
    )


def manifest_delimiter(lines: DataFrame, text: str = "line") -> str:
    """Label delimiter a manifest sets."""
    value = F.regexp_extract(text, r"^# LabelDelimiter\s+(\S+)", 1)
    return lines.agg(F.coalesce(F.max(F.nullif(value, F.lit(""))), F.lit("/"))).first()[0]


def parse_key_values(lines: DataFrame, keys: list[str], subject: str = "subject", text: str = "line") -> DataFrame:
    """One row per subject with a column per key of its ``key=value`` lines."""
    kv = lines.filter(F.col(text).contains("=")).select(
        subject, F.trim(F.substring_index(text, "=", 1)).alias("k"),
        F.trim(F.regexp_replace(text, "^[^=]*=", "")).alias("v"),
    )
    return kv.groupBy(subject).pivot("k", keys).agg(F.max("v"))


def age_group(captures: DataFrame, subjects: DataFrame, subject: str = "subject", limit: int = 20) -> DataFrame:
    """Captures with an age group: capture year minus birth year under the limit is youth."""
    years = F.col("capture_year").try_cast("int") - F.col("yob").try_cast("int")
    return captures.join(subjects, subject, "left").withColumn(
        "age_group", F.when(years.isNull(), "unknown").when(years < limit, "youth").otherwise("adult")
    )


def scan_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV with a header."""
    return spark.read.csv(path, header=True, schema=schema, quote='"', escape='"')


def attach_by_prefix(files: DataFrame, meta: DataFrame, file: str, key: str, delimiter: str = "_") -> DataFrame:
    return files.withColumn("_k", F.substring_index(file, delimiter, 1)).join(
        meta.withColumnRenamed(key, "_k"), "_k", "left"
    ).drop("_k")


def parse_cube(lines: DataFrame, text: str = "line") -> DataFrame:
    """(i, j, k, v) of sparse cube lines; directives and comments are left out."""
    f = F.split(F.btrim(text, F.lit(" \t\r\n")), r"\s+")
    return lines.filter(~F.col(text).startswith("#") & (F.trim(text) != "")).select(
        *[f[n].try_cast("int").alias(a) for n, a in enumerate("ijk")], f[3].try_cast("double").alias("v")
    )


def cube_directives(lines: DataFrame, text: str = "line") -> tuple[str | None, int | None]:
    """(color_space, bins) from ``# ColorSpace=`` and ``# BinCnt=``."""
    return lines.filter(F.col(text).startswith("#")).agg(
        F.max(F.nullif(F.regexp_extract(text, r"^# ColorSpace=(.*)$", 1), F.lit(""))).alias("color_space"),
        F.max(F.nullif(F.regexp_extract(text, r"^# BinCnt=(\d+)", 1), F.lit("")).try_cast("int")).alias("bins"),
    ).first()


def cube_lines(cube: DataFrame) -> DataFrame:
    """Non-zero cells as tab-separated lines."""
    return cube.filter("v <> 0").select(
        F.concat_ws("\t", *[F.col(c).cast("string") for c in "ijkv"]).alias("value")
    )


def import_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines) of a delimited text that may hold broken lines."""
    fields = T.StructType.fromDDL(schema)
    whole = T.StructType([*fields, T.StructField("_line", T.StringType())])
    lines = spark.read.text(path)
    parsed = F.from_csv(
        "value", whole.simpleString()[7:-1].replace(":", " "),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line", "sep": "\t"},
    )
    rows = lines.select(parsed.alias("p")).select("p.*")
    return rows.filter("_line IS NULL").drop("_line"), rows.filter("_line IS NOT NULL").select("_line")
