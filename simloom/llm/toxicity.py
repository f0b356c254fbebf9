"""Toxicity of texts, read through obfuscation.

Writers hide words by digits and signs that look like letters, by spacing letters out and by repeating them. For every word with
a sign or a repeat and every run of spaced letters, the readings of each sign form a lattice; Viterbi decoding finds the likeliest
path under a character language model of the corpus and the costs of the disguises. A separator may be dropped or part two
words. The words of the text and the restored words are then scored by a logistic model over words and word beginnings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.llm.columns import staged, whole
from simloom.llm.hashing import _buffers, lowered
from simloom.llm.learners import Ones, fit_lasso
from simloom.llm.quality import bounded_sample

#: Labelled documents to fit on at most; words that a task remembers.
FIT_ROWS, MEMO_WORDS = 20_000, 300_000
STRENGTH, LEAST_TOXIC, CHANCE = 4e-5, 4, 1e-4
#: 0 stands between words, 1-26 are letters, 27 is any byte beyond ASCII. The model looks at four characters.
SYMBOLS, SPAN, BLOCK = 28, 4, 4096

# Letters that a sign may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il",
              "|": "il", "+": "t", "(": "c", "*": "aeioustnrl", "€": "e", "£": "l"}
#: Costs in natural log units: a sign read as a letter, a repeated letter dropped, a separator dropped or read as the end of a word.
SIGN_COST, REPEAT_COST, GAP_COST, BREAK_COST = 0.5, 0.5, 0.2, 0.2
GAPS = " \t\n\x0b\x0c\r._-*~'"
_EDGE = ".,;:!?…\"'()[]{}<>#$%&*|/\\«»¿¡-_~^`"
_LETTER = re.compile(r"[^\W\d_]")
_MUTE_EDGE = "".join(c for c in _EDGE if c not in LOOKALIKES)
_REPEATED = re.compile(r"([^\W\d_])\1")
_READABLE = re.compile(r"[^\W\d_]|[" + re.escape("".join(LOOKALIKES)) + "]")
_ONE = r"[\"'(\[]*+[^\s\"'(\[][.,;:!?…\"')\]]*+"
_SPACED = re.compile(rf"(?<!\S){_ONE}(?:\s++{_ONE}){{2,}}(?!\S)")


def _table() -> np.ndarray:
    codes = np.zeros(256, np.int64)
    codes[97:123] = np.arange(1, 27)
    codes[128:] = 27
    return codes


def count_characters(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of all runs of four characters in all texts, as an array of 28 ** 4 numbers."""
    codes, size = _table(), SYMBOLS ** SPAN

    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            raw, offsets = _buffers(b.column(0))
            for lo in range(0, len(offsets) - 1, 256):
                cuts = offsets[lo:lo + 257]
                data = codes[lowered(raw[cuts[0]:cuts[-1]])]
                spread = np.zeros(len(data) + SPAN * len(cuts), np.int64)  # texts are kept apart by separators
                at = np.arange(len(data)) + SPAN * np.repeat(np.arange(1, len(cuts)), np.diff(cuts))
                spread[at] = data
                run = ((spread[:-3] * SYMBOLS + spread[1:-2]) * SYMBOLS + spread[2:-1]) * SYMBOLS + spread[3:]
                total += np.bincount(run, minlength=size)
        blocks = [total[i:i + BLOCK] for i in range(0, size, BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([x.tobytes() for x in blocks], pa.binary())],
                                         names=["block", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in rows.column("counts"))
        return pa.table({"block": rows.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    shape = "block int, counts binary"
    sums = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, shape).groupBy("block").applyInArrow(add, shape)
    out = np.zeros(size, np.int64)
    for r in sums.collect():  # 151 blocks at most
        out[r["block"] * BLOCK:r["block"] * BLOCK + len(r["counts"]) // 8] = np.frombuffer(r["counts"], np.int64)
    return out


def character_model(counts: np.ndarray) -> np.ndarray:
    """log p(character | three before) as an array of 28 ** 3 x 28: each length interpolated with the shorter one."""
    counts = counts.reshape((SYMBOLS,) * SPAN).astype(np.float64)
    counts[0, 0, 0, 0] = 0  # the space between texts
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for n in range(1, SPAN + 1):
        c = counts.sum(axis=tuple(range(SPAN - n)))
        p = (c + 5 * p) / (c.sum(-1, keepdims=True) + 5)
    return np.log(p).reshape(-1, SYMBOLS).astype(np.float32)


@lru_cache(maxsize=10_000)
def _sign(c: str, n: int) -> tuple[tuple[str, float], ...]:
    """The letters that a run of n equal signs may stand for and their cost; three stands for more."""
    if "a" <= c <= "z":
        return ((c, 0.0),) if n == 1 else ((c * 2, 0.0 if n == 2 else REPEAT_COST), (c, REPEAT_COST))
    if _LETTER.match(c):
        return ((c, 0.0),)
    like = LOOKALIKES.get(c, "")
    some = [(x, SIGN_COST) for x in like]
    if n > 1:
        some += [(x * 2, SIGN_COST) for x in like]
    if c in GAPS or not some:
        some += [("", GAP_COST), (" ", BREAK_COST)]
    return tuple(some)


def _lattice(piece: str):
    """For each run of one sign, or of white space, what it may stand for and the cost."""
    i, size = 0, len(piece)
    while i < size:
        c, j = piece[i], i + 1
        blank = c.isspace()
        while j < size and (piece[j] == c or blank and piece[j].isspace()):
            j += 1
        yield _sign(" " if blank else c, min(j - i, 3))
        i = j


def restore(piece: str, model: np.ndarray) -> str:
    """The likeliest word, or words with a space between them, behind a piece of lower-case text."""
    best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}  # last three characters -> cost and end of the cheapest path
    square, at = SYMBOLS * SYMBOLS, model.item
    for readings in _lattice(piece):
        step: dict[int, tuple[float, tuple]] = {}
        for state, (cost, path) in best.items():
            for reading, extra in readings:
                now, total = state, cost + extra
                for x in reading:
                    k = 0 if x == " " else ord(x) - 96 if "a" <= x <= "z" else 27
                    total -= at(now, k)
                    now = now % square * SYMBOLS + k
                # Per letter, so that dropping one is not cheap in itself.
                total -= 2.5 * len(reading.strip())
                if now not in step or total < step[now][0]:
                    step[now] = (total, (path, reading) if reading else path)
        best = step
    path, out = min((cost - at(state, 0), i, path) for i, (state, (cost, path)) in enumerate(best.items()))[2], []
    while path:
        path, reading = path
        out.append(reading)
    return " ".join("".join(reversed(out)).split())


def _spellings(features) -> dict:
    """The features letter by letter; under "" what a spelling is: 1 a word, 2 a beginning, 3 both."""
    top: dict = {}
    for f in features:
        node = top
        for x in f.removesuffix("^"):
            node = node.setdefault(x, {})
        node[""] = node.get("", 0) | (2 if f.endswith("^") else 1)
    return top


def _may_spell(piece: str, top: dict) -> bool:
    """Can any path through the lattice of the piece give one of the spelt features?"""
    nodes = [top]
    for readings in _lattice(piece):
        step, again = [], False
        for reading, _ in readings:
            if reading == " ":
                if any(node.get("", 0) & 1 for node in nodes):
                    return True
                again = True
                continue
            for node in nodes:
                for x in reading:
                    node = node.get(x)
                    if node is None:
                        break
                    if node.get("", 0) & 2:
                        return True
                else:
                    if not any(node is x for x in step):
                        step.append(node)
        if again and not any(top is x for x in step):
            step.append(top)
        nodes = step
    return any(node.get("", 0) & 1 for node in nodes)


class Reader:
    """Words of a text, with the restored readings of disguised ones; knows the features of words it has seen."""

    def __init__(self, model: np.ndarray, wanted: dict[str, int] | None = None):
        self.model, self.wanted, self.memo = model, wanted, {}
        self.spelt = None if wanted is None else _spellings(wanted)

    def _restored(self, piece: str) -> set[str]:
        """Words behind the piece, with and without the signs at its ends; left out if none can have a wanted feature."""
        return {x for p in {piece, piece.strip(_EDGE)} if self.spelt is None or _may_spell(p, self.spelt)
                for x in restore(p, self.model).split()}

    def readings(self, word: str) -> set[str]:
        found, core = {word.strip(_EDGE)} - {""}, word.strip(_MUTE_EDGE)
        if _READABLE.search(core) and (not core.isalpha() or _REPEATED.search(core)):
            found |= self._restored(word)
        return found

    def _features(self, readings) -> tuple:
        some = {f for x in readings for f in (x, *(f"{x[:n]}^" for n in range(3, 7) if len(x) >= n))}
        return tuple(some) if self.wanted is None else tuple(self.wanted[f] for f in some if f in self.wanted)

    def __call__(self, text: str | None) -> set:
        text = (text or "").lower()
        memo, found = self.memo, set()
        for word in set(text.split()):
            known = memo.get(word)
            if known is None:
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                known = memo[word] = self._features(self.readings(word))
            if known:
                found.update(known)
        for piece in _SPACED.findall(text):
            found.update(self._features(self._restored(piece)))
        return found


def _select(counts: DataFrame, toxic: int, clean: int) -> list[str]:
    """Features that toxic texts have more often than chance would give: P(all by chance) at most CHANCE."""
    share = toxic / max(toxic + clean, 1)
    n = F.col("toxic") + F.col("clean")
    # Chernoff bound of the binomial tail.
    q = F.col("toxic") / n
    bound = n * (q * F.log(q / F.lit(share)) + F.when(q < 1, (1 - q) * F.log((1 - q) / F.lit(1 - share))).otherwise(0.0))
    some = counts.filter((F.col("toxic") >= LEAST_TOXIC) & (q > 2 * share)).withColumn("bound", bound)
    rows = some.filter(F.col("bound") > float(-np.log(CHANCE))).orderBy(F.desc("bound"), "feature").collect()
    return [r["feature"] for r in rows]


def fit(sample: DataFrame, model: np.ndarray) -> tuple[list[str], float, np.ndarray]:
    """(features, bias, weights) from a bounded table (text, y)."""
    toxic, clean = sample.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0.0))).first()
    if not toxic or not clean:
        return [], float(np.log((toxic + 0.5) / (clean + 0.5))), np.zeros(0)

    def count(batches):
        reader = Reader(model)
        for b in batches:
            tally: dict[str, list[int]] = {}
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for f in reader(text):
                    tally.setdefault(f, [0, 0])[int(y)] += 1
            yield pa.RecordBatch.from_arrays([
                pa.array(list(tally), pa.string()), pa.array([v[1] for v in tally.values()], pa.int64()),
                pa.array([v[0] for v in tally.values()], pa.int64())], names=["feature", "toxic", "clean"])

    counts = sample.mapInArrow(count, "feature string, toxic bigint, clean bigint").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    features = _select(counts, toxic, clean)
    wanted = {f: i for i, f in enumerate(features)}

    def look(batches):
        reader = Reader(model, wanted)
        for b in batches:
            hits = [sorted(reader(text)) for text in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32())), b.column(1)], names=["hits", "y"])

    rows = sorted((tuple(r["hits"]), r["y"]) for r in sample.mapInArrow(look, "hits array<int>, y double").collect())
    bias, weights = fit_lasso(Ones([hits for hits, _ in rows], len(features)), np.array([y for _, y in rows]), STRENGTH, steps=1500)
    return features, bias, weights


def score(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic",
          fit_rows: int = FIT_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, score, carried columns): the chance of label 1 for every row of ``docs``, over the whole text.

    The character model counts all texts of ``docs``. ``learn`` is a condition on the rows of ``labels`` to fit on, at most
    about ``fit_rows`` of them, joined by key. Rows of ``labels`` with NULL label or key are left out; several labels
    of one key count one by one. Without labelled rows, or with labels of one kind, all get the smoothed share
    of ones. NULL and empty texts have no features and get the score of a text without any. An empty table gives no rows.
    """
    model = character_model(count_characters(docs, text))
    known = labels.filter(learn & F.col(label).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(label).cast("double").alias("y"))
    sample = staged(docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text")).join(
        F.broadcast(bounded_sample(known, fit_rows)), "_key").select("text", "y").repartition(24), "labelled")
    features, bias, weights = fit(sample, model)
    kept = {f: i for i, f in enumerate(features) if weights[i]}

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(model, kept)
        for column in texts:
            some = (t for i in range(0, len(column), 256) for t in column.slice(i, 256).to_pylist())
            total = np.array([bias + sum(weights[i] for i in reader(t)) for t in some], float)
            yield pa.array(1 / (1 + np.exp(-np.clip(total, -40, 40))))

    # Only texts go to Python, once; rows wait for their score in the task. A filter on the score does not ask for it again.
    chance = F.arrow_udf(run, "double").asNondeterministic()
    return docs.select(F.col(key).alias(key), chance(F.col(text).cast("string")).alias("score"), *carry)


def accepted(docs: DataFrame, labels: DataFrame, learn: Column, limit: float = 0.7, **how) -> DataFrame:
    """The rows of ``docs`` that score under ``limit``, with their columns."""
    key, text = how.pop("key", "doc_id"), how.pop("text", "text")
    named = docs.select(whole(docs).alias("_doc"), F.col(key).alias(key), F.col(text).alias(text))
    return score(named, labels, learn, key, text, carry=("_doc",), **how).filter(F.col("score") < limit).select("_doc.*")
