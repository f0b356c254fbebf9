"""Exact duplicates by two-pass Bloom filtering.

Pass one counts the filter positions of all text hashes; positions that were hit more than once form a
bitmap of bounded size. Pass two looks every row up in the bitmap: rows whose positions are not all
marked are the only ones of their text and pass straight through, the others are grouped by hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm.columns import BLANKS, join_groups, staged

#: Bits of the filter for each row, and their bound: the broadcast bitmap never takes more than 32 MB. Beyond it
#: the filter lets more rows through to the shuffle; the result is the same.
BITS_PER_ROW, MAX_BITS, PAGE_BITS = 16, 1 << 28, 32768
HASHES = 2


def _positions(bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64("text_sha256", F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def _marked(rows: DataFrame, pages: DataFrame, bits: int) -> DataFrame:
    """Adds ``_again``: all filter positions of the row were hit more than once."""
    hit = []
    for i, at in enumerate(_positions(bits)):
        page = F.broadcast(pages.select(F.col("page").alias(f"_p{i}"), F.col("bitmap").alias(f"_b{i}")))
        rows = rows.withColumn(f"_at{i}", at)
        rows = rows.join(page, (F.col(f"_at{i}") / PAGE_BITS).cast("bigint") == F.col(f"_p{i}"), "left")
        bit = F.pmod(F.col(f"_at{i}"), F.lit(PAGE_BITS)).cast("int")
        byte = F.conv(F.hex(F.substring(F.col(f"_b{i}"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
        hit.append(F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8))) == 1, F.lit(False)))
    rows = rows.withColumn("_again", reduce(lambda a, b: a & b, hit))
    return rows.drop(*[f"{c}{i}" for c in ("_at", "_p", "_b") for i in range(HASHES)])


def mark_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256, carried columns): one row per input row.

    Texts are equal when they agree after white space is taken out; NULL is the empty text. Of equal texts the
    longest original stays, then the smallest key (NULL last); of rows equal in both, exactly one. Input columns
    that are neither named nor carried are not read; a carried column that has the name of a result gives way to it.
    An empty table gives no rows.
    """
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    results = (key, "keep_id", "group_size", "kept", "text_sha256")
    rows = staged(
        docs.select(
            F.col(key).alias("_key"),
            F.sha2(F.translate(plain, BLANKS, ""), 256).alias("text_sha256"),
            F.char_length(plain).cast("bigint").alias("_chars"),
            F.monotonically_increasing_id().alias("_row"),
            F.struct(F.lit(0).alias("_none"), *[F.col(c) for c in carry if c not in results]).alias("_carry"),
        ),
        "prints",
    )
    total = rows.count()
    bits = min(MAX_BITS, max(PAGE_BITS, 1 << (BITS_PER_ROW * max(total, 1) - 1).bit_length()))
    twice = (
        rows.select(F.explode(F.array_distinct(F.array(*_positions(bits)))).alias("at"))
        .groupBy("at").agg(F.count("*").alias("n")).filter("n > 1")
    )
    pages = staged(
        twice.groupBy(F.expr(f"at div {PAGE_BITS}").alias("page"))
        .agg(F.bitmap_construct_agg(F.pmod(F.col("at"), F.lit(PAGE_BITS))).alias("bitmap")),
        "filter",
    )
    marked = _marked(rows, pages, bits)
    again = marked.filter("_again")
    order = F.struct((-F.col("_chars")).alias("c"), F.col("_key").isNull().alias("n"), F.col("_key").alias("k"),
                     F.col("_row").alias("r"))
    groups = staged(
        again.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(order).alias("_best"))
        .filter("group_size > 1"),
        "groups",
    )
    met = join_groups(again, groups, "text_sha256", "group_size", total)
    out = met.unionByName(marked.filter("NOT _again"), allowMissingColumns=True)
    single = F.col("group_size").isNull()
    return out.select(
        F.col("_key").alias(key),
        F.when(single, F.col("_key")).otherwise(F.col("_best.k")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (single | (F.col("_best.r") == F.col("_row"))).alias("kept"),
        "text_sha256",
        *[F.col(f"_carry.{c}").alias(c) for c in carry if c not in results],
    )
