"""Near-duplicate documents by a set-similarity join with adaptive multi-match prefixes.

A document's set of word shingles is ordered from rare to frequent. Its l-prefix are the first
``n - o + l`` shingles, where ``o`` is the overlap that any partner needs; partners must share at least ``l`` shingles
of their l-prefixes. Each document picks its own ``l``: a longer prefix costs more postings but asks for
more matches before a pair is compared. A pair needs the smaller ``l`` of the two.

Shingle frequencies are counted over all different sets: batches of documents send their distinct shingles, packed by
hash range, and get back those that occur in more than one set. A shingle of one set only can't be
shared, so it only shortens the part of the prefix that is looked up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.columns import join_groups, row_hash, staged, whole, with_columns
from simloom.llm.hashing import _buffers, grams, mixed, pieces, word_hashes
from simloom.operators.components import connected_components

#: Shingles that one task counts, and that one batch of documents holds, about.
PART_SHINGLES, BATCH_SHINGLES = 1 << 21, 1 << 20
MAX_MATCHES = 12
#: Postings of a pair of sets cost 1; comparing two sets costs their size over this.
POSTINGS_PER_CHECK = 8
#: Rounds in which every posting list is compared with one of its members only, before all pairs that are still in
#: different groups are. They end early when there are fewer such pairs than this many per posting.
STAR_ROUNDS, PAIRS_PER_POSTING = 6, 4


def _sets(texts, size: int):
    """For each text its distinct shingles, sorted; texts are hashed a few at a time."""
    _, offsets = _buffers(texts)
    for a, b in pieces(offsets):
        hashes, n = grams(*word_hashes(texts.slice(a, b - a)), size)
        ends = np.cumsum(n)
        yield from (np.unique(hashes[e - k:e]) for e, k in zip(ends.tolist(), n.tolist()))


def _signature(s: np.ndarray) -> int:
    """One number for a set; different sets share one with a chance of 2^-64."""
    total = mixed(np.array([s.sum(dtype=np.uint64)], np.uint64) ^ np.uint64(len(s)))
    return int((total ^ mixed(np.bitwise_xor.reduce(s)[None])).view(np.int64)[0])


def set_sizes(docs: DataFrame, key: str, text: str, size: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, n, sig, carried): size and signature of every document's set."""

    def run(batches):
        for b in batches:
            signed = [(len(s), _signature(s) if len(s) else 0) for s in _sets(b.column(1), size)]
            n, sig = zip(*signed) if signed else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.int64())],
                                             names=["row", "key", "n", "sig"])

    picked = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"),
                         F.struct(F.lit(0).alias("_none"), *carry).alias("row"))
    return picked.mapInArrow(run, with_columns(picked.schema["row"].dataType, key="bigint", n="bigint", sig="bigint"))


def _own(left: pa.Table, right: pa.Table, size: int):
    """(signatures, sets) of the batch's documents that stand for their class, each class once."""
    wanted = set(right.column("sig").to_pylist())
    out: dict[int, np.ndarray] = {}
    for s in _sets(left.column("text"), size):
        if len(s) and (sig := _signature(s)) in wanted and sig not in out:
            out[sig] = s
    return list(out), list(out.values())


def _placed(tokens: np.ndarray, parts: int) -> np.ndarray:
    """Hash range of each token in the upper half, and its key inside the range in the lower."""
    part = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return (part << np.uint64(32)) | (tokens & np.uint64(0xFFFFFFFF))


def _code(n: np.ndarray) -> np.ndarray:
    """Frequency on a logarithmic scale that fits into a byte."""
    return np.minimum(8 * np.log2(n), 255).astype(np.uint8)


def _frequency(code: np.ndarray) -> np.ndarray:
    return np.exp2(code.astype(np.float64) / 8)


def _send(size: int, parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        _, sets = _own(left, right, size)
        batch = right.column("batch")[0].as_py() if right.num_rows else 0
        tokens, n = np.unique(_placed(np.concatenate(sets), parts), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, int))
        part, keys = (tokens >> np.uint64(32)).astype(np.int64), tokens.astype(np.uint32)
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        ends = np.append(cuts[1:], len(part))
        n = np.minimum(n, 255).astype(np.uint8)
        return pa.table({
            "part": pa.array(part[cuts], pa.int64()), "batch": pa.array(np.full(len(cuts), batch), pa.int64()),
            "keys": pa.array([keys[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
            "counts": pa.array([n[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())})

    return run


def _answer(sent: pa.Table) -> pa.Table:
    """Each batch's keys that occur in more than one set, with their frequency."""
    keys = [np.frombuffer(x.as_buffer(), np.uint32) for x in sent.column("keys")]
    counts = [np.frombuffer(x.as_buffer(), np.uint8) for x in sent.column("counts")]
    known, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, np.concatenate(counts)).astype(np.int64)
    code = _code(total)
    out, at = ([], [], []), 0
    for k, batch in zip(keys, sent.column("batch").to_pylist()):
        own = back[at:at + len(k)]
        at += len(k)
        shared = total[own] > 1
        if shared.any():
            out[0].append(batch)
            out[1].append(k[shared].tobytes())
            out[2].append(code[own[shared]].tobytes())
    part = sent.column("part")[0].as_py()
    return pa.table({
        "batch": pa.array(out[0], pa.int64()), "part": pa.array([part] * len(out[0]), pa.int64()),
        "keys": pa.array(out[1], pa.binary()), "codes": pa.array(out[2], pa.binary()), "sig": pa.nulls(len(out[0]), pa.int64())})


def _matches(df: np.ndarray, base: int, limit: int) -> int:
    """The number of matches with the least estimated cost. ``df`` are frequencies in prefix order.

    The postings of the prefix are read, and no more than postings / l candidates can match l times.
    """
    read = np.cumsum(df)[base:base + limit]
    costs = read + read / np.arange(1, len(read) + 1) * (len(df) / POSTINGS_PER_CHECK)
    return int(np.argmin(costs)) + 1


def _prefixes(size: int, parts: int, num: int, den: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = right.filter(pa.compute.greater_equal(right.column("part"), 0))
        sigs, sets = _own(left, right.filter(pa.compute.less(right.column("part"), 0)), size)
        order = np.argsort(answers.column("part").to_numpy())
        keys, codes = answers.column("keys"), answers.column("codes")
        known = [np.uint64(answers.column("part")[i].as_py() << 32) | np.frombuffer(keys[i].as_buffer(), np.uint32).astype(np.uint64)
                 for i in order.tolist()]
        known = np.concatenate(known) if known else np.zeros(0, np.uint64)
        code = np.concatenate([np.frombuffer(codes[i].as_buffer(), np.uint8) for i in order.tolist()] or [np.zeros(0, np.uint8)])
        rows = []
        for sig, s in zip(sigs, sets):
            if not len(known):
                break
            asked = _placed(s, parts)
            at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            shared = known[at] == asked
            n, m = len(s), int(shared.sum())
            need = (num * n + den - 1) // den
            if m < need or not m:
                continue
            tokens, c = s[shared], code[at[shared]]
            by = np.lexsort((tokens, c))
            tokens, c = tokens[by], c[by]
            ell = _matches(_frequency(c), m - need, min(MAX_MATCHES, need))
            rows.append((sig, n, m, ell, tokens[:m - need + ell].view(np.int64), tokens.view(np.int64)))
        cols = list(zip(*rows)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["sig", "n", "m", "ell", "prefix", "tokens"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, more) whose sets overlap enough."""
    one = sets.select(F.col("sig").alias("a"), F.col("n").alias("_na"), F.col("tokens").alias("_ta"))
    two = sets.select(F.col("sig").alias("b"), F.col("n").alias("_nb"), F.col("tokens").alias("_tb"))
    both = F.size(F.array_intersect("_ta", "_tb"))
    met = pairs.join(one, "a").join(two, "b").withColumn("_both", both)
    return met.filter(F.expr(f"{den} * _both >= {num} * (_na + _nb - _both)")).select(*pairs.columns)


def _fits(num: int, den: int):
    """May sets of n (m of them shared with anyone) and _n (_m) that meet at places pos and _pos overlap enough?

    They share no more before the places than the smaller of them, and no more behind than the shorter rest.
    """
    most = "(least(pos, _pos) + least(m - pos, _m - _pos))"
    return F.expr(f"{den} * {most} >= {num} * (n + _n - {most})")


def _outer(num: int, den: int):
    """May sets (n, m) and (_n, _m) that share ``c`` tokens of their prefixes overlap enough?

    Shared tokens behind the prefix that ends first are among the ``need - ell`` that this set has left.
    """
    rest = [f"(({num} * {n} + {den - 1}) div {den} - {e})" for n, e in (("n", "ell"), ("_n", "_ell"))]
    most = f"least(m, _m, c + greatest({rest[0]}, {rest[1]}))"
    return F.expr(f"c >= least(ell, _ell) AND {den} * {most} >= {num} * (n + _n - {most})")


def _joined_labels(edges: DataFrame) -> DataFrame:
    """(u, to): components (u, v) that links connect get the smallest label within two steps."""
    both = staged(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    one = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.join(one.select(F.col("u").alias("v"), F.col("m").alias("_m")), "v").groupBy("u").agg(F.min("_m").alias("_m"))
    return one.join(near, "u").select("u", F.least("m", "_m").alias("to"))


def _links(sets: DataFrame, num: int, den: int) -> DataFrame | None:
    """(a, b) edges that connect all sets which links connect."""
    cols = ("sig", "n", "m", "ell", "comp", "pos")
    every = sets.select(F.posexplode("prefix").alias("pos", "token"), "sig", "n", "m", "ell").withColumn("comp", F.col("sig"))
    # A set needs a partner of a size in reach: den * i >= num * (n + _n - i) with i <= m and i <= _n.
    heads = every.groupBy("token").agg(F.count("*").alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi")).filter("k > 1")
    reach = F.expr(f"{num} * (n + lo) <= {num + den} * m AND {num} * n <= {den} * hi")
    posts = staged(every.join(heads, "token").filter(reach).select("token", *cols), "postings")
    size, found, before = posts.count(), None, float("inf")
    for turn in range(STAR_ROUNDS + 1):
        groups = posts.groupBy("token", "comp").agg(F.count("*").alias("k")).groupBy("token").agg(
            F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"))
        open_lists = staged(groups.filter("k * k > kk"), "open")
        left = open_lists.agg(F.sum((F.col("k").cast("double") * F.col("k") - F.col("kk")) / 2)).first()[0] or 0
        if not left:
            break
        posts = posts.join(open_lists.select("token"), "token")
        # The last round asks all pairs; it comes early when few are left or rounds stop helping.
        last = turn == STAR_ROUNDS or left <= PAIRS_PER_POSTING * size or left > 0.9 * before
        before = left
        if last:
            other = posts.select("token", *[F.col(c).alias(f"_{c}") for c in cols])
            met = posts.join(other, "token").filter((F.col("sig") < F.col("_sig")) & (F.col("comp") != F.col("_comp")))
        else:
            # The middle of a group shares most of its set; every second round asks any member.
            first = (-F.col("m") / F.col("n")).alias("r"), F.xxhash64("sig", F.lit(turn)).alias("h")
            rank = F.struct(*(first if turn % 2 == 0 else first[::-1]), *cols)
            leads = posts.groupBy("token").agg(F.min(rank).alias("l")).select("token", *[F.col(f"l.{c}").alias(f"_{c}") for c in cols])
            met = posts.join(leads, "token").filter(F.col("comp") != F.col("_comp"))
        traits = [F.first(c).alias(c) for c in ("n", "m", "ell", "comp", "_n", "_m", "_ell", "_comp")]
        pairs = met.filter(_fits(num, den)).groupBy("sig", "_sig").agg(F.count("*").alias("c"), *traits)
        # One member per list sees only a part of what two sets share, so the bound on the overlap is for the last round.
        pairs = pairs.filter(_outer(num, den) if last else F.expr("c >= least(ell, _ell)"))
        pairs = pairs.select(F.col("sig").alias("a"), F.col("_sig").alias("b"), F.col("comp").alias("u"), F.col("_comp").alias("v"))
        linked = staged(_verified(pairs, sets, num, den), "links")
        found = linked if found is None else found.unionByName(linked)
        if last:
            break
        labels = _joined_labels(linked.select("u", "v"))
        posts = staged(posts.join(labels, F.col("comp") == F.col("u"), "left").select(
            "token", "sig", "n", "m", "ell", "pos", F.coalesce("to", "comp").alias("comp")), "postings")
    return None if found is None else found.select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5,
                    threshold: tuple[int, int] = (4, 5), carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, n_shingles, component_id, component, carried columns): one row per input row.

    The set of a document are its distinct ``size``-word shingles (words are runs of characters other than white
    space, A-Z in lower case); a shorter text has one shingle, a text without words and NULL have none and are linked
    with nothing. Two documents link when den * intersection >= num * union for ``threshold`` = (num, den).
    ``component_id`` is the smallest key that links reach. Documents with equal sets are one class from the start;
    keys are 64-bit integers; ``component`` numbers the components. A NULL key takes part in links but is never the smallest; a class of NULL keys alone
    has a NULL component. Repeated keys are rows of their own. An empty table gives no rows.
    """
    num, den = threshold
    sized = staged(set_sizes(docs, key, text, size, carry), "sets")
    classes = staged(sized.filter("n > 0").groupBy("sig").agg(
        F.min("key").alias("rep"), F.max("n").alias("n"), F.count("*").alias("rows")), "classes")
    rows, shingles = classes.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    batches, parts = -(-shingles // BATCH_SHINGLES) or 1, -(-shingles // PART_SHINGLES) or 1
    batch = F.pmod(F.xxhash64("key"), F.lit(batches)).alias("batch")
    dealt = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text")).select(batch, "text")
    reps = classes.select(F.col("rep").alias("key"), "sig").select(batch, "sig")
    by_batch = dealt.groupBy("batch")
    sent = by_batch.cogroup(reps.groupBy("batch")).applyInArrow(
        _send(size, parts), "part bigint, batch bigint, keys binary, counts binary")
    shape = "batch bigint, part bigint, keys binary, codes binary, sig bigint"
    answers = sent.groupBy("part").applyInArrow(_answer, shape)
    none = F.lit(None).cast("binary")
    asked = answers.unionByName(reps.select("batch", F.lit(-1).cast("bigint").alias("part"), none.alias("keys"), none.alias("codes"), "sig"))
    found = by_batch.cogroup(asked.groupBy("batch")).applyInArrow(
        _prefixes(size, parts, num, den), "sig bigint, n bigint, m bigint, ell int, prefix array<bigint>, tokens array<bigint>")
    links = _links(staged(found, "prefixes"), num, den)
    own = classes.select("sig", "rep", "rows")
    if links is not None:
        comps = connected_components(links).select(F.col("node").alias("sig"), F.col("component").alias("comp"))
        own = own.join(comps, "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
        least = own.groupBy("comp").agg(F.min("rep").alias("component_id"))
        own = own.join(least, "comp")
    else:
        own = own.withColumn("component_id", F.col("rep")).withColumn("comp", F.col("sig"))
    own = staged(own.select("sig", "component_id", "comp", "rows"), "components")
    has = join_groups(sized.filter("n > 0"), own, "sig", "rows", rows)
    bare = sized.filter("n = 0").select("*", F.col("key").alias("component_id"))
    return has.unionByName(bare, allowMissingColumns=True).select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("comp").alias("component"),
        *[F.col(f"row.{c}").alias(c) for c in carry])


def distinct_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each component, the one with the smallest key, with the columns of ``docs``.

    Texts without words are linked with nothing, so all of them stay. Of rows that agree in every column and have words,
    one stays.
    """
    named = docs.select(whole(docs).alias("doc"), row_hash(docs).alias("_row_hash"), F.col(key).alias("key"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    marks = near_duplicates(named, "key", "text", carry=("_row_hash",), **how)
    first = F.min(F.struct(F.col("key").isNull().alias("n"), F.col("key").alias("k"), F.col("_row_hash").alias("_row_hash")))
    stays = marks.filter("n_shingles > 0").groupBy("component").agg(first.alias("f")).select("f._row_hash")
    bare = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    met = named.filter(~bare).join(stays, "_row_hash", "left_semi").dropDuplicates(["_row_hash"])
    return met.select("doc").unionByName(named.filter(bare).select("doc")).select("doc.*")
