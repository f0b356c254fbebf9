"""Near-duplicates: each item links to its single closest earlier item, links form groups.

Items are (seq, sketch[, area]) with ``seq`` the arrival order and ``sketch`` an array of values
whose agreement by position measures likeness.
"""

from __future__ import annotations

import hashlib
import math
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simloom.functions import vectors
from simloom.functions.scalars import rounded, unit01
from simloom.session import cut, spread

TEXT_SCALE = 0.27
#: Bytes of texts whose words are hashed at once; a longer text is hashed on its own.
RUN_BYTES = 4 << 20
#: Rows of a band that are compared with each other at once.
GROUP_ROWS = 512
#: Asking sketches that every task may hold, and comparisons that it makes at once.
SCAN_ROWS, ASKED_CELLS = 4096, 1 << 20


def sketched(texts: DataFrame, *keys: str, text: str = "text", positions: int = 16) -> DataFrame:
    """(keys, sketch) of the whole texts; the keys tell the texts apart.

    A task hashes each word of a run of texts once and takes the minima of every text over its words, so one short row per text is
    shuffled. Tables of a checked small size, which a scan leaves in few tasks, are dealt by key first. A text without words has no row.
    """
    each = spread(texts.select(*keys, text), *keys).select(*keys, F.lower(F.col(text)).alias("_t"))
    schema = T.StructType([*each.select(*keys).schema.fields, T.StructField("_s", T.ArrayType(T.LongType()))])

    def run(batches):
        for b in batches:
            lengths = pc.fill_null(pc.binary_length(b.column("_t")), 0).to_numpy().astype(np.int64)
            ends, at = np.cumsum(lengths), 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] - lengths[at] + RUN_BYTES, "right")))
                some, at = b.slice(at, to - at), to
                has, sketches = _minima(some.column("_t"), positions)
                if len(sketches):
                    yield pa.RecordBatch.from_arrays([*some.filter(pa.array(has)).columns[:-1], sketches], names=[*keys, "_s"])

    minima = [F.min(F.col("_s")[i]).alias(f"_m{i}") for i in range(positions)]
    return each.mapInArrow(run, schema).groupBy(*keys).agg(*minima).select(
        *keys, F.array(*[f"_m{i}" for i in range(positions)]).alias("sketch")
    )


def _minima(texts: pa.Array, positions: int) -> tuple[np.ndarray, pa.ListArray]:
    """(which texts have words, MinHash of each of these): position i holds min (a + i b) mod p, with a and b two 32-bit hashes of a word."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]]
    cuts = cuts - cuts[0]
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    heads = cuts[:-1][cuts[:-1] < len(raw)]
    begins[heads] = solid[heads]
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, cuts))
    has = counts > 0
    if not len(starts):
        return has, pa.array([], pa.list_(pa.int64()))
    # The words behind each other, without what is between them.
    packed = raw[solid]
    places = np.r_[np.cumsum(solid)[starts] - 1, len(packed)].astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(packed)]).dictionary_encode()
    digests = b"".join(hashlib.md5(w, usedforsecurity=False).digest()[:8] for w in coded.dictionary.to_pylist())
    first, second = np.frombuffer(digests, ">u4").astype(np.int64).reshape(-1, 2).T
    codes, runs = coded.indices.to_numpy(), (np.cumsum(counts) - counts)[has]
    out = np.empty((len(runs), positions), np.int64)
    for i in range(positions):
        out[:, i] = np.minimum.reduceat(((first + i * second) % vectors.SKETCH_PRIME)[codes], runs)
    return has, pa.ListArray.from_arrays(np.arange(0, out.size + 1, positions, dtype=np.int32), out.reshape(-1))


def min_agreement(scale: float, threshold: float, positions: int) -> int:
    """Fewest agreeing positions whose normalised distance is under the threshold."""
    for m in range(positions + 1):
        if 0.5 + math.atan(-scale * m) / math.pi < threshold:
            return m
    return positions + 1


def _bands(positions: list[int], misses: int) -> list[list[int]]:
    """Split positions into misses + 1 bands: two sketches with at most that many disagreements
    among them agree on at least one whole band."""
    n = min(misses + 1, len(positions))
    return [positions[i::n] for i in range(n)]


def band_keys(sketch: Column, scale: float = TEXT_SCALE, threshold: float = vectors.NEARDUP_THRESHOLD,
              positions: int = 16) -> Column:
    """Array of hashes of which two sketches under the threshold, and equal ones, share one."""
    misses = max(0, positions - min_agreement(scale, threshold, positions))
    return F.array(*[_key(sketch, (i, band)) for i, band in enumerate(_bands(list(range(positions)), misses))])


ASKS, ANSWERS = 1, 2


def _key(sketch: Column, *at: tuple[int, list[int]]) -> Column:
    """Hash of the values on one band, or on a band and one of the bands of the positions left."""
    return F.xxhash64(*[c for i, band in at for c in (F.lit(i), *[sketch[p] for p in band])])


def _meetings(rows: DataFrame, positions: int, misses: int, group_rows: int) -> DataFrame:
    """``rows`` (seq, sketch, role) once per tile in which they meet others: (key, tile, seq, sketch, role).

    Rows that disagree on at most ``misses`` positions agree on a whole band. Bands that more than ``group_rows`` rows share
    ask for a band of the other positions as well, which such rows share too. What is still large is
    dealt to a triangle of tiles, so a tile has about two thirds of ``group_rows`` rows at most.
    """
    bands = _bands(list(range(positions)), misses)
    x = F.col("sketch")
    deep = []
    for i, band in enumerate(bands):
        rest = [p for p in range(positions) if p not in band]
        more = _bands(rest, misses) if len(rest) > misses else [rest]
        deep.append(F.array(*[_key(x, (i, band), (100 + k, b)) for k, b in enumerate(more)]))
    keyed = rows.select("seq", "sketch", "role", F.posexplode(F.array(*[_key(x, (i, b)) for i, b in enumerate(bands)])).alias("band", "key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    met = keyed.join(sizes, "key")
    deeper = F.element_at(F.array(*deep), F.col("band") + 1)
    finer = met.filter(F.col("size") > group_rows).select("seq", "sketch", "role", F.explode(deeper).alias("key"))
    left = finer.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    ready = met.filter(F.col("size") <= group_rows).select("key", "size", "seq", "sketch", "role").unionByName(
        finer.join(left, "key").select("key", "size", "seq", "sketch", "role"))
    n = F.ceil(F.col("size") * 3 / group_rows).cast("int")
    part = F.pmod(F.xxhash64("seq", "role"), F.col("n")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.least(k, F.col("part")) * F.col("n") + F.greatest(k, F.col("part")))
    split = ready.withColumn("n", F.when(F.col("size") <= group_rows, F.lit(1)).otherwise(n)).withColumn("part", part)
    return split.select("key", F.explode(tiles).alias("tile"), "seq", "sketch", "role")


def _agreeing(meetings: DataFrame, least: int, every: bool) -> DataFrame:
    """(seq, other, agree): for each asking row its closest earlier answer in a tile, or with ``every`` all answers."""
    dealt = meetings.repartition("key", "tile").sortWithinPartitions("key", "tile")

    def tile(seqs: np.ndarray, values: np.ndarray, roles: np.ndarray):
        q, x = np.flatnonzero(roles & ASKS), np.flatnonzero(roles & ANSWERS)
        agree = np.zeros((len(q), len(x)), np.int16)
        for p in range(values.shape[1]):
            agree += values[q, p][:, None] == values[x, p][None, :]
        if every:
            a, b = np.nonzero(agree >= least)
            return seqs[q[a]], seqs[x[b]], agree[a, b]
        agree = np.where(seqs[x][None, :] < seqs[q][:, None], agree, -1)
        order = np.argsort(seqs[x], kind="stable")  # of equal ones the earliest
        best = order[agree[:, order].argmax(1)] if len(x) else np.zeros(len(q), int)
        score = agree[np.arange(len(q)), best] if len(x) else np.full(len(q), -1)
        found = score >= least
        return seqs[q[found]], seqs[x[best[found]]], score[found]

    def run(batches):
        held = None
        for b in chain(batches, [None]):
            if b is not None:
                held = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            if held is None or not held.num_rows:
                continue
            keys, tiles = held.column(0).to_numpy(), held.column(1).to_numpy()
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (tiles[1:] != tiles[:-1])])
            # The last tile may go on in the next batch.
            done = len(keys) if b is None else starts[-1]
            whole = held.slice(0, done)
            held = held.slice(done) if done < len(keys) else None
            if not done:
                continue
            seqs, roles = whole.column(2).to_numpy(), whole.column(4).to_numpy()
            values = whole.column(3).flatten().to_numpy(zero_copy_only=False).reshape(done, -1)
            out = [tile(seqs[a:z], values[a:z], roles[a:z]) for a, z in zip(starts, np.r_[starts[1:], len(keys)]) if a < done and z - a > 1]
            if out:
                cols = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["seq", "other", "agree"])

    return dealt.mapInArrow(run, "seq bigint, other bigint, agree bigint")


def link(items: DataFrame, scale: float = TEXT_SCALE, threshold: float = vectors.NEARDUP_THRESHOLD,
         positions: int = 16, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(seq, parent, dist) for items that have an earlier item under the threshold.

    The closest earlier item wins, ties go to the earliest. Items with one sketch collapse to the
    first of them: the others link to it at distance 0, so copies never meet each other.
    """
    least = min_agreement(scale, threshold, positions)
    usable = cut(items.select("seq", "sketch"))
    firsts = cut(usable.groupBy("sketch").agg(F.min("seq").alias("seq")))
    copies = (
        usable.join(firsts.withColumnRenamed("seq", "parent"), "sketch")
        .filter(F.col("seq") != F.col("parent"))
        .select("seq", "parent", F.lit(0.0).alias("dist"))
    )
    if least > positions:
        return copies
    return copies.unionByName(
        _best_links(firsts.withColumn("role", F.lit(ASKS | ANSWERS)), scale, least, positions, group_rows)
    )


def _best_links(rows: DataFrame, scale: float, least: int, positions: int, group_rows: int) -> DataFrame:
    met = _meetings(rows.select("seq", "sketch", "role"), positions, positions - least, group_rows)
    best = F.max(F.struct("agree", (-F.col("other")).alias("back"))).alias("b")
    agree = F.col("b.agree")
    d = F.when(agree == positions, 0.0).otherwise(unit01(F.lit(-scale) * agree))
    return _agreeing(met, least, False).groupBy("seq").agg(best).select(
        "seq", (-F.col("b.back")).alias("parent"), rounded(d).alias("dist"))


def link_probes(probes: DataFrame, items: DataFrame, scale: float = TEXT_SCALE,
                threshold: float = vectors.NEARDUP_THRESHOLD, positions: int = 16,
                group_rows: int = GROUP_ROWS) -> DataFrame:
    """``link`` when an item asks with several sketches (one ``probes`` row per variant)."""
    least = min_agreement(scale, threshold, positions)
    asks = probes.select("seq", "sketch").distinct().withColumn("role", F.lit(ASKS))
    answers = items.groupBy("sketch").agg(F.min("seq").alias("seq")).withColumn("role", F.lit(ANSWERS))
    return _best_links(cut(asks.unionByName(answers)), scale, least, positions, group_rows)


def groups(links: DataFrame) -> DataFrame:
    """(seq, grp): group = earliest item of the link tree, for linked items and their roots.

    Pointer jumping: every round replaces a parent by its parent's parent, so the number of rounds
    is the logarithm of the longest chain.
    """
    at = cut(links.select("seq", "parent"))
    while True:
        up = at.select(F.col("seq").alias("parent"), F.col("parent").alias("_up"))
        moved = at.join(up, "parent", "left")
        if moved.filter(F.col("_up").isNotNull()).isEmpty():
            break
        at = cut(moved.select("seq", F.coalesce("_up", "parent").alias("parent")))
    roots = at.select(F.col("parent").alias("seq"), F.col("parent").alias("grp")).distinct()
    return at.select("seq", F.col("parent").alias("grp")).unionByName(roots)


def with_groups(items: DataFrame, links: DataFrame) -> DataFrame:
    """All items with their group; NULL for items that have no near-duplicate."""
    return items.join(groups(links), "seq", "left")


def representatives(grouped: DataFrame) -> DataFrame:
    """(grp, rep): largest area, the earlier item on a tie."""
    key = F.struct("area", (-F.col("seq")).alias("back"))
    return (
        grouped.filter(F.col("grp").isNotNull())
        .groupBy("grp")
        .agg(F.max(key).alias("k"))
        .select("grp", (-F.col("k.back")).alias("rep"))
    )


def pairs(grouped: DataFrame) -> DataFrame:
    """Grouped items with their representative; NULL where the item is its own."""
    met = grouped.filter(F.col("grp").isNotNull()).join(representatives(grouped), "grp")
    return met.select("seq", "grp", F.nullif(F.col("rep"), F.col("seq")).alias("rep"))


def unique(grouped: DataFrame) -> DataFrame:
    """One item per group plus the ungrouped ones."""
    return grouped.join(representatives(grouped), "grp", "left").filter(
        F.col("grp").isNull() | (F.col("rep") == F.col("seq"))
    )


def against(queries: DataFrame, items: DataFrame, scale: float = TEXT_SCALE,
            threshold: float = vectors.NEARDUP_THRESHOLD, positions: int = 16, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, item_id, dist) of all items near each query, through shared bands.

    Any pair under the threshold agrees on a whole band, so nothing is missed; bands that many rows share are
    split as in ``link``. Queries with one sketch meet the items once; up to SCAN_ROWS of them are sent to
    every task, which compares its items with all, and nothing is shuffled for bands.
    """
    least = min_agreement(scale, threshold, positions)
    queries, items = cut(queries.select("query_id", "sketch")), cut(items.select("item_id", "sketch"))
    asks = queries.groupBy("sketch").agg(F.min("query_id").alias("seq")).withColumn("role", F.lit(ASKS))
    answers = items.groupBy("sketch").agg(F.min("item_id").alias("seq")).withColumn("role", F.lit(ANSWERS))
    held = asks.select("seq", "sketch").limit(SCAN_ROWS + 1).toArrow().combine_chunks()
    if held.num_rows <= SCAN_ROWS:
        near = _agreeing_all(held, answers, least).distinct()
    else:
        met = _meetings(asks.unionByName(answers).select("seq", "sketch", "role"), positions, positions - least, group_rows)
        near = _agreeing(met, least, True).distinct()
    d = F.when(F.col("agree") == positions, 0.0).otherwise(unit01(F.lit(-scale) * F.col("agree")))
    return (
        near.join(asks.select("seq", F.col("sketch").alias("_qs")), "seq")
        .join(answers.select(F.col("seq").alias("other"), F.col("sketch").alias("_xs")), "other")
        .join(queries.withColumnRenamed("sketch", "_qs"), "_qs")
        .join(items.withColumnRenamed("sketch", "_xs"), "_xs")
        .select("query_id", "item_id", rounded(d).alias("dist"))
    )


def _agreeing_all(held: pa.Table, answers: DataFrame, least: int) -> DataFrame:
    """``_agreeing`` of a bounded number of asking rows with every answer."""
    shared = None
    if held.num_rows:
        values = held.column("sketch").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(held.num_rows, -1)
        shared = held.column("seq").to_numpy(), values
    shared = answers.sparkSession.sparkContext.broadcast(shared)

    def run(batches):
        if shared.value is None:
            return
        asking, sketches = shared.value
        step = max(1, ASKED_CELLS // len(asking))
        for whole in batches:
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                values = batch.column("sketch").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                agree = np.zeros((len(asking), len(values)), np.int8)
                for p in range(values.shape[1]):
                    agree += sketches[:, p, None] == np.ascontiguousarray(values[:, p])[None, :]
                a, b = np.nonzero(agree >= least)
                cols = asking[a], batch.column("seq").to_numpy()[b], agree[a, b]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["seq", "other", "agree"])

    return answers.select("seq", "sketch").mapInArrow(run, "seq bigint, other bigint, agree bigint")


def check_declared(declared: DataFrame, items: DataFrame, scale: float = TEXT_SCALE,
                   threshold: float = vectors.NEARDUP_THRESHOLD) -> DataFrame:
    """Declared duplicates (seq, parent) with a verdict: ok, rejected, unknown or self."""
    items = cut(items.select("seq", "sketch"))
    a = items.select("seq", F.col("sketch").alias("_a"))
    b = items.select(F.col("seq").alias("parent"), F.col("sketch").alias("_b"))
    agree = vectors.agreement(F.col("_a"), F.col("_b"))
    d = F.when(F.col("_a") == F.col("_b"), 0.0).otherwise(unit01(F.lit(-scale) * agree))
    verdict = (
        F.when(F.col("seq") == F.col("parent"), "self")
        .when(F.col("_a").isNull() | F.col("_b").isNull(), "unknown")
        .when(F.round(d, 6) < threshold, "ok")
        .otherwise("rejected")
    )
    return declared.join(a, "seq", "left").join(b, "parent", "left").select("seq", "parent", verdict.alias("verdict"))


def exact_groups(items: DataFrame, value: str, key: str) -> DataFrame:
    """(digest, first, copies) of values that occur more than once."""
    return (
        items.groupBy(F.sha2(F.col(value), 256).alias("digest"))
        .agg(F.min(key).alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1")
    )
