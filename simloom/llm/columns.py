"""Native column helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType, _parse_datatype_string

from simloom.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
#: ASCII characters between words: all but letters and digits.
BETWEEN_WORDS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text: Column) -> Column:
    """Lower-case words of letters, digits and non-ASCII characters; none for NULL.

    A translation and a split at spaces is several times quicker than splitting by a pattern.
    """
    spaced = F.translate(F.coalesce(text.cast("string"), F.lit("")), BETWEEN_WORDS + UPPER, " " * len(BETWEEN_WORDS) + LOWER)
    return F.array_remove(F.split(spaced, " "), "")


def word_count(text: Column) -> Column:
    """Runs of characters that are not white space; 0 for NULL."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; NULL keys count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def row_hash(df: DataFrame) -> Column:
    """128 bits over all columns that can be hashed, and which of them are NULL: the hash itself skips NULLs."""
    cols = [x for c in df.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) if df.schema[c].dataType.typeName() not in ("map", "variant", "void")]
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(1), *cols).alias("b"))


def whole(df: DataFrame) -> Column:
    """All columns of the row as one struct, safe from names that clash."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def with_columns(row: DataType, **more: str) -> StructType:
    """Schema of a column ``row`` and further ones, given as DDL types."""
    return StructType([StructField("row", row), *[StructField(c, _parse_datatype_string(t)) for c, t in more.items()]])


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder as Parquet and read from there."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Groups above this share of all rows are broadcast: there can be no more of them than its inverse.
HOT_SHARE = 1e-4


def join_groups(rows: DataFrame, groups: DataFrame, key: str, rows_of: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group, NULL if it has none.

    The few groups that hold a large share of the rows (``rows_of`` says how many a group holds) are broadcast, so
    no task gets a hot group; the rest is joined by key.
    """
    limit = max(1000, int(total * HOT_SHARE))
    more = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(rows_of) > limit).select(key, F.struct(*more).alias("_hot"))
    met = rows.join(F.broadcast(hot), key, "left")
    done = met.filter("_hot IS NOT NULL").select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in more])
    rest = met.filter("_hot IS NULL").drop("_hot").join(groups.filter(F.col(rows_of) <= limit), key, "left")
    return done.unionByName(rest.select(*rows.columns, *more))
