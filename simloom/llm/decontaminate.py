"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are sets of positioned words that a document must contain whole. Ordered by rarity among the
documents, a window's necessary prefix is its rarest word: documents without it cannot hold the window. Only those
occurrences become candidates; the window must fit into the document around the word (length and position), and
what is left is compared word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm.columns import row_hash, staged, whole, words

WINDOW = 13
#: Tables of the benchmark side are broadcast up to this many windows (about 200 bytes each), and joined by a
#: shuffle beyond it.
BROADCAST_WINDOWS = 100_000


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(window, items): the distinct windows of ``size`` words with the sorted ids of their items, as text.

    A shorter item that has words is one window. Items without words have none; windows of items without an id count, but name no item.
    """
    parts = benchmark.select(F.col(item).cast("string").alias("i"), words(F.col(text)).alias("w")).filter("size(w) > 0")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))))
    each = parts.select("i", "w", starts.alias("at")).select("i", F.slice("w", F.col("at"), size).alias("window"))
    return each.groupBy("window").agg(F.sort_array(F.collect_set("i")).alias("items"))


def _small(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _hits(found: Column) -> Column:
    """Number of document words inside any of the windows (start, size), given in order of their start."""
    step = F.aggregate(
        found, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(x["start"] + F.size(x["window"]) - F.greatest(x["start"], a["end"]), F.lit(0))).alias("n"),
            F.greatest(a["end"], x["start"] + F.size(x["window"])).alias("end"),
        ),
    )
    return step["n"].cast("bigint")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", size: int = WINDOW, per: int = 20,
                  small_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The rows of ``docs`` as a struct ``doc`` with n_words, n_hit, n_items, items, contaminated.

    A word is hit if it lies in an occurrence of a window of any item. A document is contaminated if its hit words
    are at least one in ``per`` of its words. NULL and empty texts have no words and are clean. Equal rows get equal
    results. An empty benchmark, or one without words, leaves all documents clean.
    """
    held = docs.select(row_hash(docs).alias("_id"), F.col(text).alias("_text"), whole(docs).alias("doc"))
    cut = staged(windows(benchmark, item, item_text, size), "windows")
    small = cut.count() <= small_windows
    known = cut.select(F.explode("window").alias("word")).distinct()
    spread = docs.select(F.explode(words(F.col(text))).alias("word"))
    rarity = staged(spread.join(_small(known, small), "word").groupBy("word").agg(F.count("*").alias("n")), "rarity")
    # A word that no document has makes its window impossible.
    placed = cut.select("window", "items", F.posexplode("window").alias("off", "word")).join(rarity, "word")
    first = (
        placed.groupBy("window", "items")
        .agg(F.count("*").alias("found"), F.min(F.struct("n", "word", "off")).alias("r"))
        .filter("found = size(window)")
        .select(F.col("r.word").alias("word"), F.col("r.off").alias("off"), "window", "items")
    )
    first = staged(first, "prefixes")
    asked = first.groupBy("word").agg(F.collect_list(F.struct("off", "window", "items")).alias("asks"))
    # The hash is taken below the explode, not once per word above it.
    hashed = docs.select(row_hash(docs).alias("_id"), F.col(text).alias("_text"))
    positions = hashed.select("_id", F.posexplode(words(F.col("_text"))).alias("pos", "word"))
    met = positions.join(_small(asked, small), "word").select("_id", "pos", F.explode("asks").alias("a"))
    start = F.col("pos") - F.col("a.off")
    wanted = met.filter(start >= 0).select("_id", F.struct(start.alias("start"), "a.window", "a.items").alias("c"))
    per_doc = wanted.groupBy("_id").agg(F.sort_array(F.collect_set("c")).alias("wanted"))
    none = F.array().cast(per_doc.schema["wanted"].dataType)

    def exact(w: Column) -> Column:
        same = F.filter(F.coalesce(F.col("wanted"), none), lambda c: (c["start"] + F.size(c["window"]) <= F.size(w))
                        & (F.slice(w, c["start"] + 1, F.size(c["window"])) == c["window"]))
        return F.struct(F.size(w).cast("bigint").alias("n_words"), same.alias("_found"))

    # A row is split into words once: the explode of one element keeps what reads the result from repeating it.
    read = held.join(per_doc, "_id", "left")
    out = read.select("doc", F.explode(F.transform(F.array(words(F.col("_text"))), exact)).alias("r")).select("doc", "r.*")
    out = out.select(
        "doc", "n_words", _hits(F.col("_found")).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("_found", lambda c: c["items"])))).alias("items"))
    return out.select(
        "doc", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items",
        ((F.col("n_hit") > 0) & (per * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    return contamination(docs, benchmark, **how).filter("NOT contaminated").select("doc.*")
