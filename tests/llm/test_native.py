"""Native operators against plain Python on small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from simloom.llm import chat, columns, decontaminate, exact_dedup, mixing

BLANK = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_words(odd, rows):
    got = [r["w"] for r in odd.select(columns.words(F.col("text")).alias("w")).collect()]
    assert got == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) for _, t, _ in rows]


def test_exact_copies(odd, rows):
    got = exact_dedup.mark_copies(odd, carry=("source", "kept", "n")).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for key, text, _ in rows:
        groups[BLANK.sub("", text or "")].append((-len(text or ""), key is None, key or 0))
    for r in got:
        text = next(g for g in groups if hashlib.sha256(g.encode()).hexdigest() == r["text_sha256"])
        best = min(groups[text])
        assert r["group_size"] == len(groups[text])
        assert r["keep_id"] == (None if best[1] else best[2])
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter({r["text_sha256"]: 1 for r in got})
    assert "source" in got[0].__fields__ and "n" in got[0].__fields__


def test_exact_copies_with_a_full_filter(odd, monkeypatch):
    want = sorted(map(str, exact_dedup.mark_copies(odd).drop("kept").collect()))
    monkeypatch.setattr(exact_dedup, "MAX_BITS", 64)
    monkeypatch.setattr(exact_dedup, "PAGE_BITS", 64)
    monkeypatch.setattr(columns, "HOT_SHARE", 0.0)
    assert sorted(map(str, exact_dedup.mark_copies(odd).drop("kept").collect())) == want


def test_hot_groups_are_joined_apart(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2500, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    out = columns.join_groups(rows, groups.filter("k <> 2999"), "k", "n", 3000)
    assert out.count() == 3000 and out.filter("least IS NULL").count() == 1
    assert out.filter("n = 2500").count() == 2500


@pytest.mark.parametrize("op", ["exact", "mix", "mixed", "clean"])
def test_empty_tables(op, no_rows, spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    out = {"exact": lambda: exact_dedup.mark_copies(no_rows), "mix": lambda: mixing.mix(no_rows), "mixed": lambda: mixing.mixed(no_rows),
           "clean": lambda: decontaminate.clean(no_rows, bench)}[op]()
    assert out.count() == 0


def fill(sizes, weights, budget, passes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    free, target, left = set(order), {}, budget * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if passes * sizes[s] <= level * weight[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = passes * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(odd, rows):
    got = mixing.mix(odd).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    target, taken = fill(sizes, (3, 1, 2), 1.5, 2), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    longest = max(len(WORD.findall(t or "")) for _, t, s in rows if s == "hot")
    assert abs(taken["hot"] - target["hot"]) <= 2 * longest
    assert sorted(map(str, mixing.mix(odd.repartition(5)).collect())) == sorted(map(str, got))


def test_mixing_splits_long_queues(odd, monkeypatch):
    want = sorted(map(str, mixing.mix(odd).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    assert sorted(map(str, mixing.mix(odd).collect())) == want


def test_mixed_rows_follow_the_plan(odd):
    plan = Counter()
    for r in mixing.mix(odd).collect():
        plan[(r["doc_id"], r["size"])] += r["copies"]
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    got = Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in out.collect())
    assert got == Counter({k: n for k, n in plan.items() if n})


def contaminated(text, items, size=13):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w, hit, found = pattern.findall(lower(text)), set(), set()
    for item, t in items:
        x = pattern.findall(lower(t))
        for win in ({tuple(x[i:i + size]) for i in range(max(len(x) - size, 0) + 1)} if x else ()):
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s:s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("small", [0, 100_000])
def test_contamination(odd, rows, spark, small):
    texts = {k: t for k, t, _ in rows}
    long = texts[8].split()
    items = [(1, " ".join(long[100:140])), (2, " ".join(long[120:133]).upper() + "!"), (3, "two words"), (4, ""), (5, None),
             (6, " ".join(texts[1].split()[:13])), (7, " ".join(reversed(long[:20]))), (10, "é"), (11, "no such thing")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(odd, bench, small_windows=small).select(
        "doc.doc_id", "doc.text", "n_words", "n_hit", "n_items", "items", "contaminated").collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, found = contaminated(r["text"], items)
        assert (r["n_words"], r["n_hit"], r["items"], r["n_items"]) == (n, hit, found, len(found))
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == sum(not r["contaminated"] for r in got)


def test_nothing_to_search_for(odd, rows, spark):
    bench = spark.createDataFrame([(1, None), (None, " ")], "item_id bigint, text string")
    assert decontaminate.clean(odd, bench).count() == len(rows)


def test_items_without_an_id_hit(odd, rows, spark):
    bench = spark.createDataFrame([(None, "two words"), (4, "two words"), (None, "x")], "item_id bigint, text string")
    got = decontaminate.contamination(odd, bench).select("doc.text", "n_hit", "n_items", "items", "contaminated").collect()
    assert len(got) == len(rows)
    for r in got:
        w = lower(r["text"]).split()
        pair = {p for i in range(len(w) - 1) if w[i:i + 2] == ["two", "words"] for p in (i, i + 1)}
        hit = len(pair) + w.count("x")
        assert (r["n_hit"], r["items"], r["n_items"]) == (hit, ["4"] if pair else [], int(bool(pair)))
        assert r["contaminated"] == (hit > 0 and 20 * hit >= len(w))


def test_rotation(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "ho"), (1, 3, "ann", None), (2, 0, "system", "alone"),
             (None, 0, "cy", "x"), (3, None, "", "nobody"), (3, 1, "dee", "d"), (3, 1, "dee", "d")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    got = {(r["conv_id"], r["perspective"], r["part"]): r for r in chat.rotate(df, part_turns=3).collect()}
    assert set(got) == {(1, "ann", 0), (1, "ann", 1), (1, "bob", 0), (1, "bob", 1), (None, "cy", 0), (3, "dee", 0)}
    r = got[(1, "bob", 0)]
    assert r["rendered"] == "<|system|>\nbe kind<|end|>\n<|user name=ann|>\nhi<|end|>\n<|assistant|>\nho<|end|>\n"
    at, trained = 0, []
    for span in r["spans"]:
        if span["train"]:
            trained.append(r["rendered"][at:at + span["chars"]])
        at += span["chars"]
    assert at == len(r["rendered"]) and trained == ["ho<|end|>\n"]
    assert got[(1, "ann", 1)]["rendered"] == "<|assistant|>\n<|end|>\n"
    assert got[(3, "dee", 0)]["n_turns"] == 3 and got[(3, "dee", 0)]["n_trained"] == 2
    assert chat.rotate(df.filter("false")).count() == 0


def test_rows_with_swapped_nulls_differ(spark):
    df = spark.createDataFrame([(1, "some words", "en", None), (1, "some words", None, "en")], "doc_id int, text string, lang string, source string")
    assert df.select(columns.row_hash(df).alias("h")).distinct().count() == 2
