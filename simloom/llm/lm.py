"""Language-model scores by a weighted backoff automaton.

The n-grams of the training documents are its states: a state stands for the words just read, has an arc for every word
that followed them in training, and a failure arc to the state without its oldest word. With c(h) the count of a
history and e(h) = escape * c(h) ** decay the chance to leave it,

    arc      p(w | h) = (1 - e(h)) * c(h w) / c(h) + e(h) * p(w | shorter h)
    failure  e(h)

which sums to one over the known words and one class for all unknown ones. The empty history gives a known word
(c - discount) / N and the unknown class the rest. Reading a text from left to right, the automaton takes the arc
of the word from the state that it is in, after as many failure arcs as that needs, and adds up the logarithms on the way.

Counts are never on one machine: batches of documents send their distinct n-grams with their own counts, packed by hash
range, and get back which of them other batches have, too, and the totals of these. N-grams of three words and more go in a second
round, without those that hold a pair of words that no other batch has: the batch's own counts are their totals. From all this a task builds the part of the automaton that its
texts can reach, as tables of arcs and failure arcs, and walks all its texts at once, a word of each per step. A long text is
walked in stretches of LANE words. As a state knows at most order - 1 words, a stretch that starts in the empty state
that many words early is, at its first own word, in the state that the stretch before it ends in.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.columns import staged, word_count
from simloom.llm.hashing import mixed, word_hashes

DISCOUNT, ESCAPE, DECAY = 0.75, 0.75, -0.3
#: Tokens of one batch of documents and n-grams of one hash range, about.
BATCH_TOKENS, PART_GRAMS = 1_000_000, 1_500_000
#: Words of a text that are walked one after the other; the stretches of a longer text are walked side by side.
LANE = 256
#: Tasks of a stage at most; a task takes its batches or hash ranges one at a time, so more of them need no more memory.
TASKS = 20_000
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_STEP = np.uint64(0xD1342543DE82EF95)


def _tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, each framed by a start and an end, and their first positions (one more than texts)."""
    words, n = word_hashes(texts)
    at = np.concatenate(([0], np.cumsum(n + 2)))
    out = np.empty(at[-1], np.uint64)
    framed = np.ones(len(out), bool)
    framed[at[:-1]] = framed[at[1:] - 1] = False
    out[framed] = words
    out[at[:-1]], out[at[1:] - 1] = START, END
    return out, at


def _grams(tokens: np.ndarray, at: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, (key of the n-gram ending at each position, whether it lies in one text).

    The start counts as the oldest word of an n-gram, but not as an n-gram of one word.
    """
    depth = np.arange(len(tokens)) - np.repeat(at[:-1], np.diff(at))
    keys = tokens
    yield keys, depth > 0
    for k in range(2, order + 1):
        longer = np.zeros_like(keys)
        longer[1:] = mixed(keys[:-1] * _STEP + tokens[1:])
        keys = longer
        yield keys, depth >= k - 1


def _parts(keys: np.ndarray, parts: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _counted(keys: np.ndarray, inside: np.ndarray, train: np.ndarray):
    """Distinct keys, their counts in training texts, and where each position's key is among them."""
    known, back = np.unique(keys[inside], return_inverse=True)
    return known, np.bincount(back, train[inside], len(known)).astype(np.int64), back.astype(np.int32)


def _pieces_of(keys: np.ndarray, train: np.ndarray, n: int, parts: int):
    """Distinct keys of n-grams of ``n`` words and their counts in training texts, packed by hash range."""
    known = np.unique(keys)
    learned, times = np.unique(keys[train > 0], return_counts=True)
    count = np.zeros(len(known), np.int64)
    count[np.searchsorted(known, learned)] = times
    part = _parts(known, parts)
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)]):
        yield n, int(part[a]), _packed(known[a:b]), _planes(count[a:b])


_SENT = "n int, part bigint, batch bigint, keys binary, counts binary"


def _sent(pieces: list, batch) -> pa.Table:
    cols = list(zip(*pieces)) or [()] * 4
    return pa.table({"n": pa.array(cols[0], pa.int32()), "part": pa.array(cols[1], pa.int64()),
                     "batch": pa.array([batch] * len(pieces), pa.int64()),
                     "keys": pa.array(cols[2], pa.binary()), "counts": pa.array(cols[3], pa.binary())})


def _send(order: int, parts: int):
    """N-grams of one and two words."""

    def run(docs: pa.Table) -> pa.Table:
        tokens, at = _tokens(docs.column("text"))
        train = np.repeat(docs.column("train").to_numpy().astype(np.float64), np.diff(at))
        pieces = []
        for k, (keys, inside) in enumerate(_grams(tokens, at, min(order, 2))):
            pieces += _pieces_of(keys[inside], train[inside], k + 1, parts)
        return _sent(pieces, docs.column("batch")[0].as_py())

    return run


def _send_longer(order: int, parts: int):
    """Longer n-grams, but for those that hold a pair of words of this batch alone: no other batch has them."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _sent([], None)
        tokens, at = _tokens(docs.column("text"))
        train = np.repeat(docs.column("train").to_numpy().astype(np.float64), np.diff(at))
        pieces, met = [], None
        for k, (keys, inside) in enumerate(_grams(tokens, at, order)):
            if k == 1:
                known, back = np.unique(keys[inside], return_inverse=True)
                met = inside.copy()
                met[inside] = _told(known, None, answers, 2, parts)[back]
            elif k > 1:
                met = _chained(met)
                pieces += _pieces_of(keys[met], train[met], k + 1, parts)
        return _sent(pieces, docs.column("batch")[0].as_py())

    return run


def _chained(met: np.ndarray) -> np.ndarray:
    """Where both the n-gram ending here and the one ending a word before are met."""
    out = met.copy()
    out[1:] &= met[:-1]
    return out


def _told(known: np.ndarray, count, answers: pa.Table, n: int, parts: int) -> np.ndarray:
    """Which of the keys other batches have, too. Their totals are put into ``count``, unless that is None."""
    shared = np.zeros(len(known), bool)
    mine = answers.filter(pa.compute.equal(answers.column("n"), n))
    part = _parts(known, parts)
    for p, flags, t in zip(mine.column("part").to_pylist(), mine.column("shared"), mine.column("totals")):
        if flags.is_valid:
            a, b = np.searchsorted(part, [p, p + 1])
            shared[a:b] = other = np.unpackbits(np.frombuffer(flags.as_buffer(), np.uint8), count=b - a).astype(bool)
            if count is not None:
                count[a:b][other] = _from_planes(t.as_buffer()).astype(np.int64)
    return shared


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes apart: the high ones are mostly zero and compress away by their frequencies,
    which the codec of a shuffle doesn't look at."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpacked(data) -> np.ndarray:
    return np.cumsum(_from_planes(data), dtype=np.uint64)


def _planes(values: np.ndarray) -> bytes:
    planes = values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _from_planes(data) -> np.ndarray:
    planes = pa.decompress(data.slice(8), int.from_bytes(data.slice(0, 8).to_pybytes(), "little"), "zstd")
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


_ANSWER = "batch bigint, n int, part bigint, shared binary, totals binary, distinct bigint"


def _answer(sent: pa.Table) -> pa.Table:
    """For each batch, which of its n-grams other batches have, too, as flags in the order of its keys, and the totals of
    those; how many n-grams training has."""
    keys = [_unpacked(x.as_buffer()) for x in sent.column("keys")]
    counts = [_from_planes(x.as_buffer()).astype(np.int64) for x in sent.column("counts")]
    known, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, np.concatenate(counts)).astype(np.int64)
    several = np.bincount(back) > 1
    batches, packed, totals, at = [-1], [None], [None], 0
    for k, batch in zip(keys, sent.column("batch").to_pylist()):
        own = back[at:at + len(k)]
        at += len(k)
        other = several[own]
        if other.any():
            batches.append(batch)
            packed.append(np.packbits(other).tobytes())
            totals.append(_planes(total[own[other]]))
    m = len(batches)
    return pa.table({"batch": pa.array(batches, pa.int64()), "n": pa.array([sent.column("n")[0].as_py()] * m, pa.int32()),
                     "part": pa.array([sent.column("part")[0].as_py()] * m, pa.int64()),
                     "shared": pa.array(packed, pa.binary()), "totals": pa.array(totals, pa.binary()),
                     "distinct": pa.array([int((total > 0).sum())] + [0] * (m - 1), pa.int64())})


class Automaton(NamedTuple):
    """Arcs in the order of ``key``, which is source state * ``words`` + word; state 0 is the empty history."""

    words: int
    key: np.ndarray
    weight: np.ndarray
    target: np.ndarray
    fail: np.ndarray
    leave: np.ndarray
    start: int


def _automaton(levels, tokens: int, docs: int) -> tuple[Automaton, np.ndarray]:
    """The automaton of the n-grams of a batch that training has, and the label of the word at each position.

    ``levels`` has, for each length, (whether an n-gram ends at a position, which of the distinct ones for those where one
    does, their counts). State 1 stands for the start of a text if training has texts.
    """
    n_words, order = len(levels[0][2]), len(levels)
    ids = []
    for inside, back, _ in levels:
        each = np.full(len(inside), -1, np.int32)
        each[inside] = back
        ids.append(each)
    start = int(docs > 0)
    fail, leave, states = [np.zeros(1 + start, np.int32)], [np.zeros(1 + start)], 1 + start
    if start:
        leave[0][1] = np.log10(ESCAPE * float(docs) ** DECAY)
    keys, weights, targets, state_of, p, before = [], [], [], [], None, None
    for k, (inside, back, count) in enumerate(levels):
        place = np.zeros(len(count), np.int64)  # a position of each n-gram
        place[back] = np.flatnonzero(inside)
        seen = np.flatnonzero(count > 0)
        place, c = place[seen], count[seen].astype(np.float64)
        numbers = np.full(len(count) + 1, start, np.int32)  # the last one: the start, which has no number as a word
        numbers[seen] = np.arange(states, states + len(seen))
        if k == 0:
            source, shorter = np.zeros(len(seen), np.int32), np.zeros(len(seen), np.int32)
            chance = (c - DISCOUNT) / max(tokens, 1)
        else:
            history = ids[k - 1][place - 1]
            source, shorter = state_of[k - 1][history], state_of[k - 1][ids[k - 1][place]]
            h = np.where(history < 0, docs, before[history]).astype(np.float64)
            out = ESCAPE * h ** DECAY
            chance = (1 - out) * c / h + out * p[ids[k - 1][place]]
        last = k == order - 1
        keys.append(source * np.int64(n_words) + ids[0][place])
        weights.append(np.log10(chance))
        targets.append(shorter if last else numbers[seen])
        if not last:
            fail.append(shorter)
            leave.append(np.log10(ESCAPE * c ** DECAY))
            states += len(seen)
        p, before = np.zeros(len(count)), count
        p[seen] = chance
        state_of.append(numbers)
    key = np.concatenate(keys)
    keys.clear()
    by = np.argsort(key)
    return Automaton(n_words, key[by], np.concatenate(weights)[by], np.concatenate(targets)[by],
                     np.concatenate(fail), np.concatenate(leave), start), ids[0]


def _walk(auto: Automaton, words: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """log10 probability of each text; unknown words, which have an arc of weight 0 from the empty state to itself, add 0."""
    n = np.diff(at) - 1
    lanes = -(-n // LANE)
    text = np.repeat(np.arange(len(n)), lanes)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    warm = np.where(nth > 0, order - 1, 0)
    begin = at[:-1][text] + 1 + nth * LANE - warm
    steps = np.minimum(LANE, n[text] - nth * LANE) + warm
    by = np.argsort(-steps, kind="stable")
    begin, steps, warm = begin[by], steps[by], warm[by]
    state = np.where(nth[by] > 0, 0, auto.start if order > 1 else 0)
    total = np.zeros(len(text))
    active = np.searchsorted(-steps, -np.arange(steps[0]), "left") if len(steps) else []
    for j, m in enumerate(active):
        gained, going = np.zeros(m), np.arange(m)
        word = words[begin[:m] + j]
        while len(going):
            here = state[going]
            key = here * auto.words + word[going]
            arc = np.minimum(np.searchsorted(auto.key, key), len(auto.key) - 1)
            has = auto.key[arc] == key if len(auto.key) else np.zeros(len(key), bool)
            to, arc = going[has], arc[has]
            gained[to] += auto.weight[arc]
            state[to] = auto.target[arc]
            fails = ~has & (here > 0)
            going, here = going[fails], here[fails]
            gained[going] += auto.leave[here]
            state[going] = auto.fail[here]
        total[:m] += np.where(j >= warm[:m], gained, 0.0)
    return np.bincount(text[by], total, len(n))


_SCORED = "key {0}, train boolean, n_tokens bigint, n_known bigint, base double, score double, n int, distinct bigint"


def _score(order: int, parts: int, train_tokens: int, train_docs: int, kind: pa.DataType):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["key", "train", "n_tokens", "n_known", "base", "score", "n", "distinct"]
        if not docs.num_rows:  # the row of a hash range: only its number of n-grams
            m = answers.num_rows
            return pa.table([pa.nulls(m, kind), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                             pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), answers.column("n"), answers.column("distinct")], names=names)
        tokens, at = _tokens(docs.column("text"))
        train = np.repeat(docs.column("train").to_numpy().astype(np.float64), np.diff(at))
        levels, met = [], np.zeros(len(tokens), bool)
        for k, (keys, inside) in enumerate(_grams(tokens, at, order)):
            known, count, back = _counted(keys, inside, train)
            if k < 2:
                shared = _told(known, count, answers, k + 1, parts)
                met[:] = False
                met[inside] = shared[back]
            else:
                met = _chained(met)
                asked = np.zeros(len(known), bool)
                asked[back] = met[inside]
                totals = count[asked]
                _told(known[asked], totals, answers, k + 1, parts)
                count[asked] = totals
            levels.append((inside, back, count))
        auto, words = _automaton(levels, train_tokens, train_docs)
        inside, back, count = levels[0]
        del levels, keys
        known, base = np.zeros(len(tokens), np.int64), np.zeros(len(tokens))
        known[inside], base[inside] = count[back] > 0, np.log10(count + 1.0)[back]
        m = docs.num_rows
        return pa.table([docs.column("key"), docs.column("train"), pa.array(np.diff(at) - 1, pa.int64()),
                         pa.array(np.add.reduceat(known, at[:-1]), pa.int64()), pa.array(np.add.reduceat(base, at[:-1])),
                         pa.array(_walk(auto, words, at, order)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())], names=names)

    return run


def score(docs: DataFrame, train, key: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """(key, train, n_tokens, n_known, train_tokens, base_score, score): one row per input row.

    ``train`` is a condition on the rows whose texts are learned from. Tokens are the words of the whole text (runs of
    characters other than white space, A-Z in lower case) and one end; NULL text is empty. ``score`` is the model's
    log10 probability of the tokens under an automaton of n-grams of up to ``order`` words, ``base_score`` that of unigrams with one added to each count. n_known counts tokens
    that training has. Without training rows every token is unknown and has probability 1. Rows
    that agree are scored alike; a NULL key is a key like others; an empty table gives no rows.
    """
    picked = docs.select(F.col(key).alias("key"), F.coalesce(train, F.lit(False)).alias("train"),
                         F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = word_count(F.col("text")) + 1
    n, n_train, n_docs = (x or 0 for x in picked.agg(
        F.sum(size), F.sum(F.when(F.col("train"), size)), F.count_if("train")).first())
    batches, parts = -(-n // BATCH_TOKENS) or 1, -(-n // PART_GRAMS) or 1
    # By key and text: rows without a key, or of one key, are spread.
    to = F.pmod(F.xxhash64("key", "text"), F.lit(batches))
    tasks = min(batches, TASKS)
    dealt = picked.select(to.alias("batch"), "key", "train", "text").repartition(tasks, "batch").groupBy("batch")
    answered = lambda sent, levels: sent.repartition(min(levels * parts, TASKS), "n", "part").groupBy("n", "part").applyInArrow(
        _answer, _ANSWER).repartition(tasks, "batch")
    answers = answered(dealt.applyInArrow(_send(order, parts), _SENT), min(order, 2))
    if order > 2:
        more = dealt.cogroup(answers.groupBy("batch")).applyInArrow(_send_longer(order, parts), _SENT)
        answers = answers.unionByName(answered(more, order - 2))
    kind = picked.schema["key"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    scored = staged(dealt.cogroup(answers.groupBy("batch")).applyInArrow(
        _score(order, parts, n_train, n_docs, to_arrow_type(kind)), _SCORED.format(kind.simpleString())), "scores")
    vocabulary = scored.filter("n = 1").agg(F.sum("distinct")).first()[0] or 0
    unknown = float(np.log10(DISCOUNT * vocabulary / n_train)) if n_train else 0.0
    plus = float(np.log10(n_train + vocabulary + 1))
    return scored.filter("n IS NULL").select(
        F.col("key").alias(key), "train", "n_tokens", "n_known", F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(plus)).alias("base_score"),
        (F.col("score") + (F.col("n_tokens") - F.col("n_known")) * F.lit(unknown)).alias("score"))
