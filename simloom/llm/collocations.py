"""Phrases that occur together more often than apart, from counts of the longest windows only.

Every word is counted once, together with the words behind it: lead columns, empty where the piece of text ends. The counts
of shorter phrases are sums over these windows by prefix, so texts are taken apart once and not per length. A task counts the windows
of its own texts first (shifted columns of word numbers) and deals them by prefix: the longest prefixes are then summed where they
lie, and only ROLLUP over what is left, the still shorter ones, shuffles again. ``lead`` over a table of words would shuffle every word.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.llm.columns import join_groups, staged

#: Bytes that end a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"
#: Text that a task counts at once, in bytes.
CHUNK_BYTES = 16 << 20
#: Prefixes with this share of the windows of a sample of about so many documents are dealt to several tasks.
HOT_SHARE, SAMPLE_ROWS, SHARES = 1e-3, 4000, 64
_EXACT = "decimal(38,0)"
_FOLD = bytes(10 if b in ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_NUMBERS = 1 << 62


def count_windows(text: bytes, lang: str, longest: int, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """(head, tail, f): the distinct windows of some pieces of one language, a few at a time.

    ``head`` joins all words but the last and the language by spaces, ``tail`` is the last; words beyond a piece are empty.
    """
    data = np.frombuffer(text.translate(_FOLD), np.uint8)
    solid = (data != 32) & (data != 10)
    begins = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))
    if not len(begins):
        return
    ends = np.flatnonzero(solid & ~np.concatenate((solid[1:], [False])))
    offsets = np.concatenate(([0], np.cumsum(ends - begins + 1))).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data[solid])).dictionary_encode()
    word, size = found.indices.to_numpy(), len(found.dictionary)
    piece = np.cumsum(data == 10, dtype=np.int32)[begins]
    names = pa.concat_arrays([pa.array([""], pa.large_string()), found.dictionary]).cast(pa.string())
    del data, solid, begins, ends, offsets, found
    leads = [word + 1]
    for k in range(1, longest):
        lead = np.zeros(len(word), np.int32)
        lead[:-k] = np.where(piece[k:] == piece[:-k], word[k:] + 1, 0) if k < len(word) else lead[:-k]
        leads.append(lead)
    key, span = leads[0].astype(np.int64), size + 1
    for lead in leads[1:]:
        if span >= _NUMBERS // (size + 1):
            same, key = np.unique(key, return_inverse=True)
            span = len(same)
        key, span = key * (size + 1) + lead, span * (size + 1)
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    del key, word, piece
    for at in range(0, len(first), rows):
        columns = [names.take(pa.array(lead[first[at:at + rows]])) for lead in leads]
        head = pc.binary_join_element_wise(*columns[:-1], pa.scalar(lang), " ")
        yield pa.RecordBatch.from_arrays([head, columns[-1], pa.array(count[at:at + rows], pa.int64())], names=["head", "tail", "f"])


def windows(docs: DataFrame, longest: int, text: str = "text", lang: str = "lang", missing: str = "und") -> DataFrame:
    """(head, tail, f): windows of ``longest`` words, counted within a task (see ``count_windows``)."""

    def flush(held: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for name in sorted(held):
            yield from count_windows(b"\n".join(held.pop(name)), name, longest)

    def run(batches):
        held, size = defaultdict(list), 0
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                held[name].append(t.as_py())
                size += len(held[name][-1])
                if size >= CHUNK_BYTES:
                    yield from flush(held)
                    size = 0
        yield from flush(held)

    picked = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(missing)).alias("lang"),
                         F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return picked.mapInArrow(run, "head string, tail string, f bigint")


def _hot_heads(docs: DataFrame, longest: int, text: str, lang: str) -> list[str]:
    """Prefixes that hold much of a sample: at most 1 / HOT_SHARE. They steer the layout only."""
    total = docs.count()
    if not total:
        return []
    seen = windows(docs.sample(min(1.0, SAMPLE_ROWS / total), seed=7), longest, text, lang).groupBy("head").agg(F.sum("f").alias("f"))
    seen = staged(seen, "phrase-sample")
    least = (seen.agg(F.sum("f")).first()[0] or 0) * HOT_SHARE
    return sorted(r["head"] for r in seen.filter(F.col("f") > max(least, 1)).collect())


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, size, phrase, f): phrases of up to ``longest`` words met at least ``least`` times, ``phrase`` an array.

    Size 0 is the language itself: ``f`` is then the number of its words, however few.
    """
    hot = _hot_heads(docs, longest, text, lang)
    share = F.pmod(F.xxhash64("tail"), F.lit(SHARES)) + 1
    salt = F.when(F.col("head").isin(hot), share).otherwise(0) if hot else F.lit(0)
    spread = windows(docs, longest, text, lang).withColumn("salt", salt.cast("int")).repartition("head", "salt")
    parts = F.split("head", " ", longest)
    name, head = F.get(parts, F.lit(longest - 1)).alias("lang"), F.slice(parts, 1, longest - 1)
    # Conditions on the counts keep filters above the shuffles, so all branches read the same ones.
    counted = spread.groupBy("head", "salt", "tail").agg(F.sum("f").alias("f"))
    top = counted.filter(F.when(F.col("f") >= least, F.col("tail")) != "").select(name, F.lit(longest).alias("size"), F.concat(head, F.array("tail")).alias("phrase"), "f")
    # Prefixes that can be met often enough, and the next shorter one of all of them.
    heads = spread.groupBy("head", "salt").agg(F.sum("f").alias("f"), F.max(F.octet_length("tail")).alias("bytes"))
    frequent = (F.col("f") >= least) | (F.col("salt") > 0) | (F.col("bytes") < 0)
    sizes = F.when(frequent, F.array(F.lit(longest - 2), F.lit(longest - 1))).otherwise(F.array(F.lit(longest - 2)))
    sums = heads.select("head", "f", F.explode(sizes).alias("size")).select(
        name, "size", F.call_function("substring_index", "head", F.lit(" "), "size").alias("words"), "f").groupBy("lang", "size", "words").agg(F.sum("f").alias("f"))
    sums = sums.withColumn("size", F.when(F.col("f") > 0, F.col("size")))
    phrase = F.slice(F.split("words", " "), F.lit(1), F.col("size")).alias("phrase")
    # ROLLUP to the still shorter ones, down to (lang) and (): bits of the id count the columns that are summed away.
    below = max(longest - 3, 0)
    names = [f"w{i + 1}" for i in range(below)]
    rolled = sums.filter(F.col("size") == longest - 2).select("lang", *[F.get(F.split("words", " "), F.lit(i)).alias(n) for i, n in enumerate(names)], "f")
    rolled = rolled.rollup("lang", *names).agg(F.sum("f").alias("f"), F.grouping_id().alias("g"))
    size = reduce(lambda c, k: c.when(F.col("g") == (1 << (below - k)) - 1, k), range(1, below + 1), F.when(F.col("g") == (1 << below) - 1, 0))
    rolled = rolled.withColumn("size", size).filter("size IS NOT NULL")
    rolled = rolled.select("lang", "size", F.slice(F.array(*names, F.lit("")), F.lit(1), F.col("size")).alias("phrase"), "f")
    # An empty last word is the end of a piece: no phrase of that size.
    both = sums.filter(F.col("size") > 0).select("lang", "size", phrase, "f").unionByName(rolled)
    return top.unionByName(both.filter((F.col("size") == 0) | ((F.col("f") >= least) & (F.get("phrase", F.col("size") - 1) != ""))))


def _score(a: Column, first: Column, rest: Column, scale: int) -> Column:
    """floor(scale * a * a / (first * rest)) in whole numbers of up to 38 digits."""
    wide = [x.cast("decimal(19,0)") for x in (a, first, rest)]
    over = (wide[0] * wide[0]).cast(_EXACT) * F.lit(scale).cast("decimal(10,0)")
    under = (wide[1] * wide[2]).cast(_EXACT)
    return F.call_function("div", over.cast(_EXACT), under)


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, first: int = 2000, share: int = 50, scale: int = 1_000_000,
                 text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``first`` phrases of two to ``longest`` words of every language.

    A phrase met ``a`` times is as good as its worst cut: with ``l`` and ``r`` the counts of both sides, scale * a * a / (l * r),
    rounded down, ties to the shorter left side. ``n`` counts the words of the language. A phrase is left out if a longer one that holds
    it has at least ``share`` per cent of its count. Ranks go by score and ``a``, descending, then by the bytes of the phrase.
    NULL text is empty, a NULL language is ``und``, an empty table gives no rows, other columns are left out. Counts are exact: words are
    told apart by their bytes and scores have 38 digits.
    """
    if longest < 2:
        raise ValueError("phrases have at least two words")
    counts = staged(phrase_counts(docs, longest, least, text, lang), "phrase-counts")
    languages = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    total = languages.agg(F.sum("n")).first()[0] or 0
    phrases = counts.filter("size > 0").select("lang", "size", "phrase", "f")
    long = phrases.filter("size > 1").withColumnRenamed("f", "a")

    # Longer phrases speak for every shorter one inside them.
    inner = [F.slice("phrase", i + 1, k) for k in range(2, longest) for i in range(longest - k + 1)]
    sizes = [(i + k, k) for k in range(2, longest) for i in range(longest - k + 1)]
    held = long
    if inner:
        inside = F.array(*[F.when((F.col("size") > k) & (F.col("size") >= upto), x) for x, (upto, k) in zip(inner, sizes)])
        over = (long.filter("size > 2").select("lang", F.explode(inside).alias("phrase"), "a").filter("phrase IS NOT NULL")
                .groupBy("lang", "phrase").agg(F.max("a").alias("most")))
        held = long.join(over, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("most") < share * F.col("a"), F.lit(True)))

    parts = phrases.select(F.struct("lang", "phrase").alias("part"), F.col("f").alias("of_part"))
    cuts = held.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    for name, cut in (("l", F.slice("phrase", F.lit(1), F.col("k"))),
                      ("r", F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k")))):
        cuts = join_groups(cuts.withColumn("part", F.struct("lang", cut.alias("phrase"))), parts, "part", "of_part", total)
        cuts = cuts.withColumnRenamed("of_part", name).drop("part")
    scored = cuts.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r"), scale))
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    ready = worst.select("lang", F.array_join("phrase", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")

    # One language may hold most phrases: only the best of each of its shares are ranked together. With this number of
    # shares the largest share is about as long as the list of their best.
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = 1 + math.isqrt(total // (least * first))
    near = ready.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*best))).filter(F.col("_r") <= first)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")).filter(F.col("rank") <= first)
    return ranked.join(languages, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
