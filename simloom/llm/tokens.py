"""Token ids in binary shards, with a minimal perfect hash index for keyed access.

Documents are range-sorted by key, and every task encodes its range into shard files of raw little-endian ids, 16 bits wide
while all ids fit. The index deals keys to buckets by hash; a bucket maps its n keys to the slots 0 to n - 1
without storing them: on each level a key sets one bit of a bitmap, keys that are alone on their bit keep it, the others go on
to the next level, and the slot is the number of set bits before it (Limasset et al., 2017). A slot holds a fingerprint of
its key, the shard, the place in it and the length, so a look-up reads one index row and one slice of one file.
"""

from __future__ import annotations

import gc
import os
import threading
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simloom.llm.columns import staged
from simloom.llm.hashing import _buffers, _chunk, mixed, pieces

#: Text of one task and ids of one shard file, in bytes; keys of one index bucket, about.
TASK_BYTES, SHARD_BYTES, BUCKET_KEYS = 8 << 20, 64 << 20, 4096
#: Bytes of text, and new words, that are encoded at once: what is held for a word while it is new is some hundred times its size.
PIECE_BYTES, NEW_WORDS = 1 << 18, 1 << 13
#: Words that a worker remembers, at most, and ids of all of them; a power of two and a bound.
MEMO_WORDS, MEMO_IDS = 1 << 21, 1 << 23
#: Seconds without a task after which a worker lets go of its encoder.
IDLE_SECONDS = 3.0
#: Punctuation that a tokenizer may part from the word before it.
_BEHIND = ".,;:!?#$%&*|()"
_SALT = np.uint64(0xA24BAED4963EE407)


class WordEncoder:
    """Ids of whole texts for a tokenizer that splits at white space: every word is encoded once and remembered by its hash.

    If the tokenizer parts a word from the punctuation behind it, they are remembered apart, and if it lowers
    letters, A-Z and a-z are one; both is tried out on the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        one = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.lower = one("Ab") == one("ab") and one("Éa") == one("ÉA")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        apart = all(one(f"w{a}{b}") == one("w" if a == "" else f"w{a}") + one(b) for a in ("", "o", "0") for b in (*_BEHIND, _BEHIND))
        self.width = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.marks = np.array([apart and b < 128 and chr(b) in _BEHIND for b in range(256)])
        self.clear()

    def clear(self) -> None:
        """Forgets all words. A word has two places by its hash; a third word for a place drives out the one that is there."""
        self.known = np.zeros(MEMO_WORDS, np.uint64)
        self.starts, self.lengths = np.zeros(MEMO_WORDS, np.uint32), np.zeros(MEMO_WORDS, np.uint32)
        self.pool, self.used = np.zeros(MEMO_IDS + (MEMO_IDS >> 3), self.width), 0

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(MEMO_WORDS - 1)
        return (hashes & mask).astype(np.int64), (hashes >> np.uint64(32) & mask).astype(np.int64)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Start and length in the pool of distinct new words, which are remembered too."""
        lengths, first = np.zeros(len(words), np.int64), self.used
        for s in range(0, len(words), NEW_WORDS):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words[s:s + NEW_WORDS], add_special_tokens=False)]
            some = np.fromiter(map(len, found), np.int64, len(found))
            lengths[s:s + NEW_WORDS], end = some, self.used + int(some.sum())
            if end > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros(max(len(self.pool) >> 1, end - len(self.pool)), self.width)))
            self.pool[self.used:end] = np.fromiter(chain.from_iterable(found), self.width, end - self.used)
            self.used = end
        starts = first + np.cumsum(lengths) - lengths
        first, second = self._places(hashes)
        place = np.where((self.known[first] != 0) & (self.known[second] == 0), second, first)
        _, one = np.unique(place, return_index=True)
        place = place[one]
        self.known[place], self.starts[place], self.lengths[place] = hashes[one], starts[one], lengths[one]
        return starts, lengths

    def __call__(self, texts: pa.Array, end: int):
        """Pieces of (ids of some texts in order, each text followed by ``end``; ids per text)."""
        raw, offsets = _buffers(texts)
        for a, b in pieces(offsets, PIECE_BYTES):
            if self.used > MEMO_IDS:
                self.clear()
            whole = raw[offsets[a]:offsets[b]].tobytes()
            # Special tokens are found as they are written.
            folds = not any(x in whole for x in self.special)
            hashes, per_text, first, last = _chunk(raw, offsets[a:b + 1], self.lower and folds, self.marks if folds else None)
            hashes |= hashes == 0  # 0 is an empty place
            place, other = self._places(hashes)
            place = np.where(self.known[place] == hashes, place, other)
            missing = np.flatnonzero(self.known[place] != hashes)
            starts, size = self.starts[place].astype(np.int64), self.lengths[place].astype(np.int64)
            if len(missing):
                new, where, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
                at = missing[where]
                learnt = self._learn(new, [raw[x:y + 1].tobytes().decode() for x, y in zip(first[at].tolist(), last[at].tolist())])
                starts[missing], size[missing] = learnt[0][back], learnt[1][back]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            ids = self.pool[np.arange(total) + np.repeat(starts - (ends - size), size)] if total else np.zeros(0, self.width)
            upto = np.concatenate(([0], ends))[np.cumsum(per_text)]
            yield np.insert(ids.astype(np.uint32), upto, end), np.diff(upto, prepend=0) + 1


def kept_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process for a tokenizer file; one is kept, with the words that it remembers.

    This package travels to the executors by value, so its globals are new in every task: the encoder hangs on an installed module.
    """
    import tokenizers

    file = os.stat(path)
    which = path, file.st_mtime_ns, file.st_size
    kept = tokenizers.__dict__.setdefault("_simloom_encoders", {})
    if timer := kept.pop("timer", None):
        timer.cancel()
    encoder = kept.get(which)
    if encoder is None:
        kept.clear()
        encoder = kept[which] = WordEncoder(path)
    return encoder


def drop_when_idle(seconds: float = IDLE_SECONDS) -> None:
    """Lets go of the kept encoder unless a task asks for it soon: the worker goes on to other operators, which need the memory."""
    import tokenizers

    kept = tokenizers.__dict__.get("_simloom_encoders", {})
    if timer := kept.pop("timer", None):
        timer.cancel()

    def let_go() -> None:
        if kept.get("timer") is threading.current_thread():
            kept.clear()
            gc.collect()  # what came by value refers to itself

    kept["timer"] = timer = threading.Timer(seconds, let_go)
    timer.daemon = True
    timer.start()


def _open(folder: str):
    return fs.FileSystem.from_uri(folder)


_ENTRY = "key {0}, seq int, shard string, width int, at bigint, n_tokens bigint"


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end: int = 2, key: str = "doc_id", text: str = "text",
                 task_bytes: int = TASK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode all texts into shard files under ``folder``; (key, seq, shard, width, at, n_tokens): a row per document.

    Ids go in ascending key order, NULL first, and end with ``end``; NULL text is empty and has the end id only. The
    rows of one key stay together and are numbered by ``seq`` in the order of their texts. ``at`` is the place
    in the shard, counted in ids. ``folder`` must be one that all executors and pyarrow.fs reach. Shard names sort in
    document order. A repeated task writes files of its own; the rows name those that count.
    """
    picked = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranged = picked.repartitionByRange(max(1, -(-total // task_bytes)), "key").sortWithinPartitions("key", "text")

    def run(batches):
        store, root = _open(folder)
        encode = kept_encoder(tokenizer)
        width = 2 if max(encode.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end) < 1 << 16 else 4
        store.create_dir(root, recursive=True)
        part, turn, at, out, name, last, seq = TaskContext.get().partitionId(), 0, 0, None, "", object(), 0
        tag = uuid.uuid4().hex
        try:
            for b in batches:
                rows, seqs, keys = ([], [], []), [], iter(b.column(0).to_pylist())
                for ids, sizes in encode(b.column(1), end):
                    payload, upto = memoryview(ids.astype(f"<u{width}").tobytes()), 0
                    for n in sizes.tolist():
                        k = next(keys)
                        seq, last = (seq + 1 if k == last else 0), k
                        if out is None or at * width >= shard_bytes:
                            if out is not None:
                                out.close()
                            name, at = f"{part:08d}-{turn:06d}-{tag}.bin", 0
                            out, turn = store.open_output_stream(f"{root}/{name}"), turn + 1
                        out.write(payload[upto * width:(upto + n) * width])
                        seqs.append(seq)
                        rows[0].append(name)
                        rows[1].append(at)
                        rows[2].append(n)
                        at, upto = at + n, upto + n
                m = b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(seqs, pa.int32()), pa.array(rows[0], pa.string()), pa.array([width] * m, pa.int32()),
                     pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64())],
                    names=["key", "seq", "shard", "width", "at", "n_tokens"])
        finally:
            if out is not None:
                out.close()
            drop_when_idle()

    kind = picked.schema["key"].dataType.simpleString()
    return staged(ranged.mapInArrow(run, _ENTRY.format(kind)), "entries")


def shard_starts(entries: DataFrame) -> DataFrame:
    """(shard, start): ids in all shards before this one. One row per shard."""
    sizes = entries.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("bigint").alias("start"))


def minimal_hash(hashes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(bitmaps by level, slot of each hash) for distinct 64-bit hashes."""
    levels, left, slots, used = [], np.arange(len(hashes)), np.zeros(len(hashes), np.int64), 0
    while len(left):
        bits = -(-max(len(left), 8) // 8) * 8
        at = level_bits(hashes[left], len(levels), bits)
        alone = np.bincount(at, minlength=bits) == 1
        levels.append(np.packbits(alone, bitorder="little"))
        fixed = alone[at]
        slots[left[fixed]] = used + (np.cumsum(alone) - 1)[at[fixed]]
        used, left = used + int(alone.sum()), left[~fixed]
    return levels, slots


def level_bits(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mixed(hashes ^ (np.uint64(int(_SALT) * (level + 1) & 0xFFFFFFFFFFFFFFFF))) % np.uint64(bits)).astype(np.int64)


def slots_of(hashes: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Slot of each hash, -1 for hashes that surely were not indexed."""
    slots, left, used = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), 0
    for level, packed in enumerate(levels):
        bitmap = np.unpackbits(packed, bitorder="little").astype(bool)
        at = level_bits(hashes[left], level, len(bitmap))
        fixed = bitmap[at]
        slots[left[fixed]] = used + (np.cumsum(bitmap) - 1)[at[fixed]]
        used, left = used + int(bitmap.sum()), left[~fixed]
    return slots


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes + _SALT) >> np.uint64(32)).astype(np.uint32)


def _hashed(keys: DataFrame, buckets: int) -> DataFrame:
    h = F.xxhash64("key", "seq")
    return keys.withColumn("hash", h).withColumn("bucket", F.pmod(h, F.lit(buckets)))


_INDEX = ("bucket bigint, width int, levels array<binary>, marks binary, shards array<string>, shard binary, at binary, n_tokens binary,"
          " twin_keys array<string>, twin_seqs array<int>, twin_rows array<int>")


def _build(rows: pa.Table) -> pa.Table:
    hashes = rows.column("hash").to_numpy().view(np.uint64)
    _, first, count = np.unique(hashes, return_index=True, return_counts=True)
    order = np.sort(first[count == 1])
    twins = np.setdiff1d(np.arange(len(hashes)), order)  # keys of one 64-bit hash: kept by name behind the slots
    levels, slots = minimal_hash(hashes[order])
    place = np.empty(len(hashes), np.int64)
    place[slots] = order
    place[len(order):] = twins
    names, shard = np.unique(rows.column("shard").to_pylist(), return_inverse=True)
    keys, seqs = rows.column("key").cast(pa.string()).to_pylist(), rows.column("seq").to_pylist()
    return pa.table({
        "bucket": rows.column("bucket").slice(0, 1), "width": rows.column("width").slice(0, 1),
        "levels": pa.array([[x.tobytes() for x in levels]], pa.list_(pa.binary())),
        "marks": pa.array([fingerprints(hashes[place]).tobytes()], pa.binary()),
        "shards": pa.array([names.tolist()], pa.list_(pa.string())),
        "shard": pa.array([shard[place].astype(np.uint32).tobytes()], pa.binary()),
        "at": pa.array([rows.column("at").to_numpy()[place].tobytes()], pa.binary()),
        "n_tokens": pa.array([rows.column("n_tokens").to_numpy()[place].tobytes()], pa.binary()),
        "twin_keys": pa.array([[keys[i] for i in twins]], pa.list_(pa.string())),
        "twin_seqs": pa.array([[seqs[i] for i in twins]], pa.list_(pa.int32())),
        "twin_rows": pa.array([(len(order) + np.arange(len(twins))).tolist()], pa.list_(pa.int32()))})


def build_index(entries: DataFrame, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """(one row per bucket, number of buckets), from the rows of ``write_shards``."""
    buckets = max(1, -(-entries.count() // bucket_keys))
    rows = _hashed(entries, buckets).select("bucket", "hash", F.col("key").cast("string").alias("key"), "seq", "shard", "width", "at", "n_tokens")
    return staged(rows.groupBy("bucket").applyInArrow(_build, _INDEX), "index"), buckets


def _locate(keys: pa.Table, index: pa.Table) -> pa.Table:
    m = keys.num_rows
    hit = np.zeros(m, bool)
    shard, at, n, width = np.full(m, None), np.zeros(m, np.int64), np.zeros(m, np.int64), 0
    if m and index.num_rows:
        row = {c: index.column(c)[0] for c in index.column_names}
        marks, which = (np.frombuffer(row[c].as_buffer(), np.uint32) for c in ("marks", "shard"))
        ats, ns = (np.frombuffer(row[c].as_buffer(), np.int64) for c in ("at", "n_tokens"))
        names, width = np.array(row["shards"].as_py(), object), row["width"].as_py()
        hashes = keys.column("hash").to_numpy().view(np.uint64)
        slots = slots_of(hashes, [np.frombuffer(x.as_buffer(), np.uint8) for x in row["levels"].values])
        twins = {(k, s): r for k, s, r in zip(row["twin_keys"].as_py(), row["twin_seqs"].as_py(), row["twin_rows"].as_py())}
        if twins:
            texts = keys.column("key").cast(pa.string()).to_pylist()
            own = [twins.get(x, -1) for x in zip(texts, keys.column("seq").to_pylist())]
            slots = np.where(np.array(own) >= 0, own, slots)
        safe = np.maximum(slots, 0)
        hit = (slots >= 0) & (marks[safe] == fingerprints(hashes))
        shard[hit], at[hit], n[hit] = names[which[safe[hit]]], ats[safe[hit]], ns[safe[hit]]
    return pa.table({"key": keys.column("key"), "seq": keys.column("seq"), "shard": pa.array(shard.tolist(), pa.string()),
                     "width": pa.array(np.full(m, width), pa.int32()), "at": pa.array(at, mask=~hit), "n_tokens": pa.array(n, mask=~hit)})


def locate(index: DataFrame, buckets: int, keys: DataFrame) -> DataFrame:
    """(key, seq, shard, width, at, n_tokens) for keys (key, seq); NULL places for keys that are not indexed."""
    kind = keys.schema["key"].dataType.simpleString()
    asked = _hashed(keys.select("key", F.col("seq").cast("int").alias("seq")), buckets)
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(_locate, _ENTRY.format(kind))


def fetch(folder: str, places: DataFrame) -> DataFrame:
    """``places`` (see ``locate``) with ``ids``: the ids as little-endian 32-bit numbers, read from the shard files."""
    kind = places.schema["key"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        store, root = _open(folder)
        width = rows.column("width")[0].as_py()
        out = []
        with store.open_input_file(f"{root}/{rows.column('shard')[0].as_py()}") as f:
            for at, n in zip(rows.column("at").to_pylist(), rows.column("n_tokens").to_pylist()):
                raw = f.read_at(n * width, at * width)
                out.append(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())
        return rows.append_column("ids", pa.array(out, pa.binary()))

    found = places.filter("shard IS NOT NULL")
    return found.groupBy("shard").applyInArrow(run, _ENTRY.format(kind) + ", ids binary")


def encode(docs: DataFrame, tokenizer: str, folder: str, end: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, seq, shard, start, n_tokens, ids): writes shards and index, then reads every document back by its key.

    ``start`` counts the ids of all documents before. One row per input row, also for repeated and NULL keys (see
    ``write_shards``); an empty table writes nothing and gives no rows.
    """
    entries = write_shards(docs, tokenizer, folder, end, key, text)
    index, buckets = build_index(entries)
    wanted = docs.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).select(
        "key", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("seq"))
    read = fetch(folder, locate(index, buckets, wanted)).join(shard_starts(entries), "shard")
    return read.select(F.col("key").alias(key), "seq", "shard", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids")
