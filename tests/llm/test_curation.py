"""Phrase mining, conversation repair and the rule cascade against plain Python."""

import hashlib
import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from simloom.llm import cascade, collocations, queries_curation, repair
from simloom.llm.registry import QUERIES

NEW = ("op11_collocations", "op12_conversation_repair", "op13_quality_rules")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def phrases(rows, longest):
    found, words = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    found[lang, tuple(w[i:i + k])] += 1
    return found, +words


def best(rows, longest, least, first, share=50, scale=1_000_000):
    f, n = phrases(rows, longest)
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cands.items():
        inside = [b for (m, q), b in cands.items() if m == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= share * a for b in inside):
            continue
        score, _, l, r = min((scale * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:first], 1)}


@pytest.fixture(scope="module")
def chatter(spark):
    rng = random.Random(1)
    bits, gaps = ["a", "b", "cc", "É", "a b", "A"], [" ", " ", "  ", "\t", ". ", "\n"]
    rows = [(rng.choice(["en", "de fr", None]), "".join(rng.choice(bits) + rng.choice(gaps) for _ in range(rng.randrange(60)))) for _ in range(60)]
    rows += [("x", None), ("y", ""), (None, "A"), ("en", "a b cc " * 3000)]
    return rows, spark.createDataFrame(rows, "lang string, text string").select("*", F.lit(1).alias("head"), F.lit(2).alias("f"))


@pytest.mark.parametrize("longest", [2, 3, 4])
@pytest.mark.parametrize("hot", [1e-3, 2.0])
def test_phrase_counts(chatter, monkeypatch, longest, hot):
    monkeypatch.setattr(collocations, "HOT_SHARE", hot)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 700)
    rows, df = chatter
    got = collocations.phrase_counts(df, longest, 5).collect()
    found, words = phrases(rows, longest)
    assert Counter({(r.lang, tuple(r.phrase)): r.f for r in got if r["size"]}) == Counter({k: v for k, v in found.items() if v >= 5})
    assert {r.lang: r.f for r in got if not r["size"]} == dict(words)


@pytest.mark.parametrize("longest,first", [(2, 5), (3, 2000), (4, 7)])
def test_collocations(chatter, longest, first):
    rows, df = chatter
    got = collocations.collocations(df, longest, 6, first)
    assert {tuple(r) for r in got.collect()} == best(rows, longest, 6, first)
    with pytest.raises(ValueError):
        collocations.collocations(df, 1)


def test_scores_beyond_64_bits(spark):
    a, l, r = 3_000_000_007, 9_000_000_011, 7_000_000_003
    df = spark.createDataFrame([(a, l, r)], "a bigint, l bigint, r bigint")
    got = df.select(collocations._score(F.col("a"), F.col("l"), F.col("r"), 1_000_000).alias("s")).first()["s"]
    assert got == 1_000_000 * a * a // (l * r)


def test_collocations_of_documents(odd, no_rows):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert {tuple(r) for r in collocations.collocations(odd, 3, 10, 50).collect()} == best(rows, 3, 10, 50)
    assert collocations.collocations(no_rows).count() == 0


def cheapest(turns):
    """Tries all edits of a short conversation: (cost, letters, repaired rows)."""
    found = []

    def go(i, cost, letters, done):
        if i == len(turns):
            for tail in itertools.chain.from_iterable(itertools.product("ua", repeat=k) for k in range(3)):
                finish(cost + 3 * len(tail), letters + "I" * len(tail), done + [({"u": "user", "a": "assistant"}[x], "") for x in tail])
            return
        role, text, fault = turns[i]
        for ins in itertools.chain.from_iterable(itertools.product("ua", repeat=k) for k in range(3)):
            c, at, d = cost + 3 * len(ins), letters + "I" * len(ins), done + [({"u": "user", "a": "assistant"}[x], "") for x in ins]
            go(i + 1, c + 4, at + "D", d)
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                go(i + 1, c + extra, at + "K", d + [(role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, c + 3 + extra, at + "R", d + [(new, text)])

    def finish(cost, letters, done):
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or " " for r, _ in done)):
            found.append((cost, letters, done))

    go(0, 0, "", [])
    return min(found, key=lambda x: x[:2])


def told(rows):
    """What the contract says of one conversation's (turn, role, text) rows."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, turns = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        turns.append((role, text, fault))
    numbers = [t for t, _, _ in rows if t is not None]
    faults = Counter(f for _, _, f in turns)
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    cost, letters, done = cheapest(turns)
    text = "\n".join(f"{r}:{x}" for r, x in done)
    return (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal,
            cost, letters, hashlib.sha256(text.encode()).hexdigest()), [(r, x) for r, x in done]


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(3)
    texts = ["One.", "Two!", "cut", "", None, "Same?", "Same?", " . \n", "é"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ursula"]
    rows = []
    for conv in [None, *range(40)]:
        for i in range(rng.randrange(1, 4)):
            rows.append((conv, rng.choice([i, i, i + 2, None]), rng.choice(roles), rng.choice(texts)))
    return rows, spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").select("*", F.lit("x").alias("key"), F.lit(0).alias("kind"))


@pytest.mark.parametrize("limits", [(1 << 16, 32 << 20), (1, 1)])
def test_repair(talks, spark, limits):
    rows, df = talks
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3 if limits[0] == 1 else 10_000)
    try:
        got = {r[0]: tuple(r)[1:] for r in repair.audit(df, limits=limits).collect()}
        edits = repair.repair(df, limits=limits).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 41
    for conv in got:
        want, done = told([r[1:] for r in rows if r[0] == conv])
        assert got[conv] == want
        own = sorted((r for r in edits if r["conv_id"] == conv), key=lambda r: r["n"])
        assert [r["n"] for r in own] == list(range(1, len(own) + 1)) and "".join(r["edit"] for r in own) == want[6]
        assert [(r["role"], r["text"]) for r in own if r["edit"] != "D"] == done and sum(r["cost"] for r in own) == want[5]


def test_a_long_conversation(spark):
    n = 30_000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                               F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    r = repair.audit(df, limits=(5000, 1 << 30)).first()
    assert r["audit"] == "K" * n and r["cost"] == 0
    text = "\n".join(f"{'ua'[i % 2] == 'u' and 'user' or 'assistant'}:{i}." for i in range(n))
    assert r["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_lost_turns_and_empty_tables(spark):
    rows = [(1, 0, "user", "a.", True), (1, 1, "user", "b.", True), (2, 0, "user", "a.", True), (2, 1, "user", "a.", False), (2, 2, "assistant", "b.", None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, gone boolean")
    got = {r[0]: tuple(r)[1:] for r in repair.audit(df, lost="gone").collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1] == (0, 0, 0, 0, 0, 0, "", empty)
    assert got[2] == (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:a.\nassistant:b.").hexdigest())
    assert repair.audit(df.filter("false"), lost="gone").count() == 0 and repair.repair(df.filter("false")).count() == 0


def measure(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    again = {p for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for p in range(i, i + 5)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(again), "n_lines": len(lines), "n_upper": sum("A" <= c <= "Z" for c in text), "n_lower": sum("a" <= c <= "z" for c in text),
            "n_shouts": text.count("!"), "n_digits": sum(c in "0123456789" for c in text),
            "n_cut_lines": sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in lines), "longest_word": max(map(len, w), default=0)}


def rejects(m):
    return {"few_words": m["n_words"] < 10, "repeated_windows": 100 * m["n_repeat_words"] > 20 * m["n_words"], "symbols": 10 * m["n_symbols"] > m["n_words"],
            "word_length": not 2 * m["n_words"] <= m["word_chars"] <= 15 * m["n_words"], "repeated_lines": 100 * m["n_dup_lines"] > 40 * m["n_lines"],
            "capitals": 100 * m["n_upper"] > 60 * (m["n_upper"] + m["n_lower"]), "shouting": 10 * m["n_shouts"] > 3 * m["n_words"],
            "digits": 100 * m["n_digits"] > 60 * m["word_chars"], "cut_lines": 100 * m["n_cut_lines"] > 50 * m["n_lines"], "longest_word": m["longest_word"] > 1000}


@pytest.fixture(scope="module")
def texts(odd, spark):
    rng = random.Random(9)
    made = ["a b c d e f a b c d e", "x " * 40, "line one here\nline one here\nline one here\nand more words to come now", "SHOUT " * 3 + "é" * 40, "1 2 3 4 5 6 7 8 9 10 11 12",
            "cut off...\nagain… \nand whole\n\n \nmore words to fill this text up", "w" * 1500 + " a b c d e f g h i j k", "#tag | * $ % & < > many symbols in so few words here"]
    made += [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(60))) for _ in range(60)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id bigint, text string").unionByName(odd.select("doc_id", "text"))


def test_measures(texts):
    got = cascade.measured(texts, tuple(cascade.MEASURES)).select("doc.text", "measure").collect()
    for r in got:
        m = r["measure"].asDict()
        m.pop("_none")
        assert m == measure(r["text"]), r["text"]


@pytest.mark.parametrize("report", [(), ("n_words", "n_repeat_words")])
def test_cascade(texts, report):
    got = cascade.screen(texts, report=report).select("doc.text", "rejected_by", "kept").collect()
    assert len(got) == texts.count()
    for r in got:
        verdict = rejects(measure(r["text"]))
        assert r["kept"] == (not any(verdict.values()))
        assert r["kept"] if r["rejected_by"] is None else verdict[r["rejected_by"]]


def test_order_of_rules():
    # The second rule rejects most for its cost; the first is left with one document, the third with three.
    assert cascade.best_order([(0b011, 5), (0b001, 1), (0b110, 2), (0b100, 3)], [1.0, 1.0, 1.0]) == [1, 2, 0]
    assert cascade.best_order([(0b01, 4), (0b10, 5)], [1.0, 10.0]) == [0, 1]


def test_rules_behind_the_first_rejection_do_not_run(spark):
    df = spark.createDataFrame([("few",)], "text string")
    rules = (cascade.Rule("few", lambda m: m("n_words") < 10), cascade.Rule("breaks", lambda m: F.raise_error(F.lit("reached")).cast("boolean")))
    plan = cascade.plan
    cascade.plan = lambda *a, **k: [0, 1]
    try:
        assert cascade.screen(df, rules).first()["rejected_by"] == "few"
    finally:
        cascade.plan = plan


def test_cascade_of_an_empty_table(no_rows):
    assert cascade.screen(no_rows, report=("n_words",)).count() == 0


def test_clashing_names(odd):
    assert cascade.screen(odd).select("doc.*").columns == odd.columns


def test_queries(spark):
    assert set(NEW) <= set(QUERIES)
    turns = spark.createDataFrame([(None, None, None, None), (7, 1, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string")
    assert all(None not in (r["role"], r["text"]) for r in queries_curation.damaged(turns).collect())
