import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from simloom.llm import lm


def split(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


class Backoff:
    """States as tuples of words, one arc at a time."""

    def __init__(self, texts, order):
        self.order, self.seen, self.left = order, Counter(), Counter()
        for t in texts:
            w = ["START", *split(t), "END"]
            for i in range(1, len(w)):
                for k in range(min(order, i + 1)):
                    self.seen[tuple(w[i - k:i + 1])] += 1
                    self.left[tuple(w[i - k:i])] += 1
        self.n = self.left[()]
        self.v = sum(len(g) == 1 for g in self.seen)

    def leave(self, state):
        return 0.75 * self.left[state] ** -0.3

    def arc(self, state, word):
        if not state:
            return (self.seen[word,] - 0.75) / self.n if self.seen[word,] else 0.75 * self.v / self.n if self.n else 1.0
        shorter = self.arc(state[1:], word) if self.seen[state[1:] + (word,)] or len(state) == 1 else self.leave(state[1:]) * self.arc(state[2:], word)
        return (1 - self.leave(state)) * self.seen[state + (word,)] / self.left[state] + self.leave(state) * shorter

    def log10(self, text):
        state = ("START",) if self.order > 1 and self.left["START",] else ()
        total = 0.0
        for word in [*split(text), "END"]:
            while state and not self.seen[state + (word,)]:
                total += math.log10(self.leave(state))
                state = state[1:]
            total += math.log10(self.arc(state, word))
            state = (state + (word,))[-(self.order - 1):] if self.order > 1 else ()
            while state and not self.left[state]:
                state = state[1:]
        return total


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("train", ["doc_id % 3 <> 0", "false"])
def test_scores_of_the_automaton(odd, rows, train, order, monkeypatch):
    monkeypatch.setattr(lm, "BATCH_TOKENS", 3000)
    monkeypatch.setattr(lm, "PART_GRAMS", 1000)
    got = lm.score(odd, F.expr(train), order=order).collect()
    model = Backoff([t for k, t, _ in rows if train != "false" and k is not None and k % 3], order)
    want = sorted((str(k), len(split(t)) + 1, round(model.log10(t), 5)) for k, t, _ in rows)
    assert [(a, b) for a, b, _ in want] == sorted((str(r["doc_id"]), r["n_tokens"]) for r in got)
    found = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in got)
    assert [x for *_, x in found] == pytest.approx([x for *_, x in want], abs=1e-4)


def test_stretches_give_the_scores_of_one_walk(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 6, n)) for n in (0, 1, 4, 5, 6, 200, 31)]
    tokens, at = lm._tokens(pa.array(texts))
    train = np.repeat([1.0, 1, 0, 1, 0, 1, 0], np.diff(at))
    for order in (2, 3, 5):
        levels = []
        for keys, inside in lm._grams(tokens, at, order):
            _, count, back = lm._counted(keys, inside, train)
            levels.append((inside, back, count))
        auto, words = lm._automaton(levels, int(train[tokens != lm.START].sum()), 4)
        walks = []
        for lane in (1000, 7, 5):
            monkeypatch.setattr(lm, "LANE", lane)
            walks.append(lm._walk(auto, words, at, order))
        assert np.allclose(walks[0], walks[1], atol=1e-9) and np.allclose(walks[0], walks[2], atol=1e-9)
        model = Backoff([t for t, use in zip(texts, [1, 1, 0, 1, 0, 1, 0]) if use], order)
        assert walks[0] == pytest.approx([model.log10(t) for t in texts])


def test_every_state_leaves_one():
    texts = pa.array(["a b c a b", "b b a", "c", "a b a b c"])
    tokens, at = lm._tokens(texts)
    levels = []
    for keys, inside in lm._grams(tokens, at, 3):
        _, count, back = lm._counted(keys, inside, np.ones(len(tokens)))
        levels.append((inside, back, count))
    n = len(tokens) - 4
    auto, _ = lm._automaton(levels, n, 4)
    v = len(levels[0][2])

    def chance(state, word):
        i = np.searchsorted(auto.key, state * auto.words + word)
        if i < len(auto.key) and auto.key[i] == state * auto.words + word:
            return 10 ** auto.weight[i]
        return 0.75 * v / n if not state else 10 ** auto.leave[state] * chance(auto.fail[state], word)

    inner = set((auto.key // auto.words).tolist())
    assert len(inner) > 8
    never = auto.words  # no arc has it: its key would be word 0 of the next state
    auto = auto._replace(words=auto.words + 1, key=auto.key // auto.words * (auto.words + 1) + auto.key % auto.words)
    for state in inner:
        assert sum(chance(state, w) for w in range(never + 1)) == pytest.approx(1)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm.score(empty, F.lit(True), order=3).count() == 0
