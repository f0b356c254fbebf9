"""Operators that work in Python tasks, against plain Python on small tables."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from simloom.llm import hashing, html_text, jaccard, learners, lm, quality, tokens, toxicity
from simloom.session import scratch_path


def split(text):
    return (text or "").encode().lower().split()


def test_word_and_gram_hashes(rows, monkeypatch):
    monkeypatch.setattr(hashing, "CHUNK", 100)
    texts = [t for _, t, _ in rows]
    words, n = hashing.word_hashes(pa.array(texts))
    want = [split(t) for t in texts]
    assert n.tolist() == [len(w) for w in want]
    names = dict(zip((x for w in want for x in w), words.tolist()))
    assert [names[x] for w in want for x in w] == words.tolist() and len(set(names.values())) == len(names)
    grams, n = hashing.grams(words, n, 4)
    want = [[tuple(w[i:i + 4]) for i in range(len(w) - 3)] or ([tuple(w)] if w else []) for w in want]
    assert n.tolist() == [len(w) for w in want]
    names = dict(zip((x for w in want for x in w), grams.tolist()))
    assert [names[x] for w in want for x in w] == grams.tolist() and len(set(names.values())) == len(names)


def components(rows, size, num, den):
    sets = []
    for _, t, _ in rows:
        w = split(t)
        sets.append({tuple(w[i:i + size]) for i in range(max(len(w) - size, 0) + 1)} if w else set())
    least = [k for k, *_ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((k for (k, *_), x in zip(rows, group) if x == g and k is not None), default=None) for g in group}
    return [(k, len(s), least[g] if s else k) for (k, *_), s, g in zip(rows, sets, group)]


def ordered(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("size,num,den", [(4, 85, 100), (5, 4, 5), (2, 1, 2)])
def test_near_duplicates(odd, rows, size, num, den, monkeypatch):
    monkeypatch.setattr(jaccard, "BATCH_SHINGLES", 500)
    monkeypatch.setattr(jaccard, "PART_SHINGLES", 700)
    got = jaccard.near_duplicates(odd, size=size, threshold=(num, den), carry=("source",))
    assert ordered(tuple(r)[:3] for r in got.collect()) == ordered(components(rows, size, num, den))


@pytest.fixture(scope="module")
def crowd(spark):
    """Copies of one text with a few changed words each: dense where links are, but no common centre."""
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.integers(0, 5)):
            w[rng.integers(0, 120)] = f"x{rng.integers(0, 4000)}"
        rows.append((k, " ".join(w), None))
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, source string")


@pytest.mark.parametrize("rounds,per", [(6, 50), (0, 2), (6, 0), (3, 0)])
def test_near_duplicates_in_a_crowd(crowd, monkeypatch, rounds, per):
    rows, df = crowd
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "PAIRS_PER_POSTING", per)
    got = jaccard.near_duplicates(df, size=4, threshold=(85, 100)).drop("component").collect()
    assert ordered(map(tuple, got)) == ordered(components(rows, 4, 85, 100))


def test_one_document_per_component(odd, rows):
    out = jaccard.distinct_documents(odd)
    assert out.columns == odd.columns
    want = components(rows, 5, 4, 5)
    bare = [k for k, n, _ in want if not n]
    stays = {c for k, n, c in want if n}
    got = [r["doc_id"] for r in out.collect()]
    assert Counter(k for k in got if k is not None) == Counter([*[k for k in bare if k is not None], *[c for c in stays if c is not None]]) + Counter({13: 1})


def automaton(rows, train):
    uni, bi, hist = Counter(), Counter(), Counter()
    for (_, t, _), use in zip(rows, train):
        w = [*split(t), "END"]
        if use:
            uni.update(w)
            bi.update(zip(["START", *w], w))
            hist.update(["START", *w[:-1]])
    n, v = sum(uni.values()), len(uni)
    out = []
    for k, t, _ in rows:
        w, total, base = [*split(t), "END"], 0.0, 0.0
        for h, x in zip(["START", *w], w):
            base += math.log10((uni[x] + 1) / (n + v + 1))
            p = (uni[x] - 0.75) / n if uni[x] else (0.75 * v / n if n else 1.0)
            if hist[h]:
                leave = 0.75 * hist[h] ** -0.3
                p = (1 - leave) * bi[h, x] / hist[h] + leave * p
            total += math.log10(p)
        out.append((k, len(w), sum(uni[x] > 0 for x in w), n, base, total))
    return out


@pytest.mark.parametrize("train", ["doc_id % 3 <> 0", "false"])
def test_language_model(odd, rows, train, monkeypatch):
    monkeypatch.setattr(lm, "BATCH_TOKENS", 300)
    monkeypatch.setattr(lm, "PART_GRAMS", 200)
    got = lm.score(odd, F.expr(train)).drop("train").collect()
    use = [train != "false" and k is not None and k % 3 != 0 for k, *_ in rows]
    key = lambda r: (r[1], round(r[4], 6), round(r[5], 6), str(r[0]))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(automaton(rows, use), key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4]) and a[5] == pytest.approx(b[5])


def test_language_model_sums_to_one(spark):
    texts = ["a b c a b", "b b a", "c"]
    vocabulary = ["a", "b", "c", "never", None]  # None: the text ends
    for history in ("a", "b", "c", "never"):
        rows = [(i, t, 1) for i, t in enumerate(texts)] + [(10 + i, f"{history} {x}" if x else history, 0) for i, x in enumerate(vocabulary)]
        rows.append((99, history, 2))
        out = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(rows, "doc_id bigint, text string, t int"), F.col("t") == 1).collect()}
        # p(x | history) = p(history x END) / (p(history) p(END | x)): compare through the sequential version.
        want = {k: s for k, *_, s in automaton([(k, t, None) for k, t, _ in rows], [t == 1 for *_, t in rows])}
        assert all(out[k]["score"] == pytest.approx(want[k]) for k in want)
    assert lm.score(spark.createDataFrame([], "doc_id bigint, text string"), F.lit(True)).count() == 0


def test_trigrams_help(spark):
    rows = [(i, "the red house on the green hill by the blue lake", True) for i in range(5)] + [(9, "the red house on the green hill by the blue lake", False)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, t boolean")
    two, three = (lm.score(df, F.col("t"), order=n).filter("doc_id = 9").first()["score"] for n in (2, 3))
    assert two < three < 0


def test_token_shards(odd, rows, spark, monkeypatch):
    monkeypatch.setattr(tokens, "BUCKET_KEYS", 16)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = tokens.encode(odd, path, scratch_path(spark, "shards")).collect()
    want, start = [], 0
    for k, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert ordered((r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in got) == ordered(want)


def test_encoder_agrees_with_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, encode = Tokenizer.from_file(path), tokens.WordEncoder(path)
    texts = ["Hello, World!", "<|endoftext|> x<|startoftext|>y", "a b c\x1cd\x85e", "don't we'll I'M", "e ́ é", "", "  ", "ᄀ ᅡ Straße ǅ İ", "1234 5,6", "a,b c.d! e?! f$$$ g,'s h.’ i,́ é, j1, K2. ÉÀ, #x (y) z):",
             "<|ENDOFTEXT|> end,<|endoftext|>, A<|endoftext|>"]
    ids, n = (np.concatenate(x) for x in zip(*encode(pa.array(texts), 2)))
    ends = np.cumsum(n)
    for t, e, k in zip(texts, ends, n):
        assert ids[e - k:e].tolist() == [*library.encode(t, add_special_tokens=False).ids, 2]


def test_missing_keys_and_small_shards(spark):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    folder = scratch_path(spark, "shards")
    entries = tokens.write_shards(rows, public_tokenizers.path("word_bpe_49k.json"), folder, shard_bytes=64)
    assert entries.select("shard").distinct().count() > 20
    index, buckets = tokens.build_index(entries, 50)
    asked = spark.range(490, 510).select(F.col("id").alias("key"), F.lit(0).alias("seq"))
    found = tokens.locate(index, buckets, asked).collect()
    assert {r["key"] for r in found if r["shard"]} == set(range(490, 500)) and len(found) == 20


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_minimal_hash(n):
    keys = hashing.mixed(np.arange(n, dtype=np.uint64))
    levels, slots = tokens.minimal_hash(keys)
    assert sorted(slots.tolist()) == list(range(n))
    assert tokens.slots_of(keys, levels).tolist() == slots.tolist()


def test_keys_of_one_hash_are_kept_by_name(spark):
    rows = pa.table({"bucket": pa.array([0] * 3), "hash": pa.array([5, 5, 9]), "key": pa.array(["1", "2", "3"]), "seq": pa.array([0, 0, 0], pa.int32()),
                     "shard": ["s"] * 3, "width": pa.array([2] * 3, pa.int32()), "at": pa.array([0, 10, 20]), "n_tokens": pa.array([10, 10, 1])})
    found = tokens._locate(rows.select(["bucket", "hash", "key", "seq"]), tokens._build(rows))
    assert found.column("at").to_pylist() == [0, 10, 20]


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="nav-open"><header><h1>Site</h1></header>
<nav><a href=/>Home</a></nav><div class="cookieNotice">We use cookies</div><main><h1>Title &amp; more</h1>
<p>Hello&nbsp;world <b>x</b>y.<p class=ad>Buy now<p>Second<br>line<aside>side</aside><ul><li>one<li>two</ul><form>Name<input></form>
<script>if (a</b) "</p>x"</script><!-- <p>no</p> --><section id="comments"><p>I liked it a lot</p></section></main><footer>foot</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more Hello world xy. Second line one two"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<br><p> </p>") == ""
    plain = "<div><a href=1>Home</a> <a href=2>News</a></div><div><p>" + "word " * 40 + "</p><p>" + "more " * 50 + "</p></div><div><a href=3>next</a></div>"
    assert html_text.main_text(plain) == ("word " * 40 + "more " * 50).strip()


def test_names_of_furniture_do_not_hide_the_article():
    long, more = " ".join(["word"] * 40), " ".join(["more"] * 30)
    for start, end in (("<article class='post category-social tag-search'>", "</article>"), ("<main class='has-sidebar'>", "</main>"),
                       ("<article class='related-post widget'>", "</article>"), ("<body class=x><main id='content-sidebar'>", "</main>")):
        page = f"<nav><a href=/>Home</a></nav>{start}<h1>Title</h1><p>{long}</p><p>{more}</p>{end}<div class='sidebar'>{more}</div>"
        assert html_text.main_text(page) == f"Title {long} {more}"
    page = f"<article><p>{long}</p><section id='discussion'><p>{more}</p></section><p class='side'>{long}</p><div class='ad'>Buy it now and save</div><p>{more}</p></article>"
    assert html_text.main_text(page) == f"{long} {more} {long} {more}"


LONG, MORE, SAID = " ".join(["word"] * 40), " ".join(["more"] * 30), " ".join(["said"] * 45)


@pytest.mark.parametrize("other", [
    f"<section class='comments'><p>{SAID}</p><p>{SAID}</p></section>", f"<div id='comments'><p>{SAID}</p></div>", f"<div class='cookie-notice'><p>{SAID}</p></div>",
    f"<div class='sidebar'><p>{SAID}</p></div>", f"<div class='advert'><p>{SAID}</p></div>", f"<article class='comment'><p>{SAID}</p></article>",
    f"<div class='newsletter-signup'>{SAID}</div>", f"<ul class='commentlist'><li>{SAID}<li>{SAID}</ul>", f"<div class='related-posts'><p>{SAID}</p></div>",
    f"<div class='related'><p>{SAID}</p></div>"])
def test_containers_of_other_text(other):
    for tag in ("article", "main"):
        page = f"<nav><a href=/>Home</a></nav><{tag}><h1>Title</h1><p>{LONG}</p>{other}<p>{MORE}</p></{tag}><footer>foot</footer>"
        assert html_text.main_text(page) == f"Title {LONG} {MORE}"
    assert html_text.main_text(f"<div><h1>Title</h1><p>{LONG}</p><p>{MORE}</p></div>{other}") == f"Title {LONG} {MORE}"
    assert html_text.main_text(f"<main><h1>Title</h1><p>{LONG}</p></main><article class='related'><p>{SAID}</p></article>") == f"Title {LONG}"


def test_names_that_say_little():
    kept = f"<section id='discussion'><h2 id='related-work'>Related work</h2><p>{MORE}</p></section><section class='related-work'><p>{MORE}</p></section>"
    assert html_text.main_text(f"<article><p>{LONG}</p>{kept}</article>") == f"{LONG} Related work {MORE} {MORE}"


def test_pages_without_an_article():
    page = f"<div><a href=1>Home</a> <a href=2>News</a></div><div><h1>A short title</h1><p>{LONG}</p><h2>Next part</h2><p>{MORE}</p><p>The end.</p></div><div><a href=3>next</a></div>"
    assert html_text.main_text(page) == f"A short title {LONG} Next part {MORE} The end."


def test_very_long_and_broken_pages():
    page = "<article>" + "".join(f"<p>{LONG}" for _ in range(3000)) + "<div>" * 300 + f"<p>{MORE}"
    assert html_text.main_text(page) == " ".join([LONG] * 3000 + [MORE])


def test_extraction_keeps_columns(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old", 1), (2, None, None, None, 2), (2, None, None, None, 2)], "page_id int, url string, html string, text string, `a.b` int")
    out = html_text.extract(df)
    assert out.columns == ["page_id", "url", "a.b", "text"] and [r["text"] for r in out.collect()][1:] == ["", ""]
    assert html_text.extract(df.filter("false")).count() == 0


def test_labelled_blocks_are_learned():
    rows = np.array(html_text.LABELLED)
    assert np.mean([learners.predict_tree(html_text.tree(), r[:-1]) >= 0.5 for r in rows] == (rows[:, -1] == 1)) > 0.95


def labelled(spark, bad):
    rng = np.random.default_rng(1)
    rows, marks = [], []
    for i in range(240):
        w = [f"w{rng.integers(0, 300)}" for _ in range(40)]
        y = i % 4 == 0
        rows.append((i, bad(w, i) if y else " ".join(w)))
        marks.append((i, int(y)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, label int")


def accuracy(out, labels):
    m = out.join(labels, "doc_id").filter("doc_id >= 160")
    return m.agg(F.avg(((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("int"))).first()[0]


def test_quality_rules(spark):
    docs, labels = labelled(spark, lambda w, i: " | ".join(w) if i % 8 else " ".join([w[0]] * 40))
    out = quality.score(docs, labels, F.col("doc_id") < 160, label="label")
    assert accuracy(out, labels) > 0.97 and out.count() == 240


def test_compiled_rules_score_as_the_model(spark):
    x = np.random.default_rng(0).random((50, len(quality.STATISTICS)))
    y = (x[:, 1] + x[:, 3] > 1).astype(float)
    bias, rules = quality.fit(x, y)
    df = spark.createDataFrame(x.tolist(), list(quality.STATISTICS))
    got = [r[0] for r in df.select(quality.compiled(bias, rules)).collect()]
    want = 1 / (1 + np.exp(-(bias + sum(w * learners.fires(r, x) for r, w in rules))))
    assert rules and got == pytest.approx(want.tolist())


HIDDEN = ("1d10t", "i d i o t", "idiiiiot", "i.d.i.o.t", "!d!ot", "IDIOT")


def test_restoring():
    counts = np.zeros(28 ** 4, np.int64)
    for word, n in (("idiot", 40), ("hello", 30), ("good", 30), ("the", 90)):
        s = [0, 0, 0, *[ord(c) - 96 for c in word], 0]
        for a in zip(s, s[1:], s[2:], s[3:]):
            counts[((a[0] * 28 + a[1]) * 28 + a[2]) * 28 + a[3]] += n
    model = toxicity.character_model(counts)
    assert np.exp(model).sum(1) == pytest.approx(1, abs=1e-4)
    for piece in HIDDEN[:5]:
        assert toxicity.restore(piece, model) == "idiot"
    assert toxicity.restore("gooood", model) == "good" and toxicity.restore("h3ll0", model) == "hello"


def test_toxicity_through_disguise(spark):
    docs, labels = labelled(spark, lambda w, i: " ".join([*w[:20], "idiot" if i < 160 else HIDDEN[i // 4 % len(HIDDEN)], *w[20:]]))
    out = toxicity.score(docs, labels, F.col("doc_id") < 160, label="label")
    assert accuracy(out, labels) > 0.95


SPELLINGS = {"f001": "fool", "h473": "hate", "d13": "die", "a55": "ass", "@55": "ass", "1d107": "idiot", "ki||": "kill", "ki!!": "kill",
             "i..d..i..o..t": "idiot", "s--c--u--m": "scum", "what a l o s e r": "loser", "w h a t a l o s e r !": "loser", "i    d    i    o    t": "idiot"}


def test_toxicity_through_every_spelling(spark):
    bad, said = sorted(set(SPELLINGS.values())), "what a day and what a night for you and all of them"
    learnt = [(i, f"{said} {bad[i // 4 % len(bad)]} {said}" if i % 4 == 0 else said, int(i % 4 == 0)) for i in range(240)]
    asked = [(1000 + i, f"{said} {x} {said}", 1) for i, x in enumerate(SPELLINGS)] + [(2000, f"{said} 555-8394 {said}!!", 0), (2001, f"a b c {said}", 0)]
    docs = spark.createDataFrame(learnt + asked, "doc_id bigint, text string, toxic int").repartition(4)
    got = {r[0]: r[1] for r in toxicity.score(docs, docs, F.col("doc_id") < 240).select("doc_id", "score").collect()}
    assert {k: got[k] >= 0.5 for k, *_ in asked} == {k: bool(y) for k, _, y in asked}


def test_toxic_words_beyond_five_hundred_features(spark):
    words = [a + b + c for a in ("ba", "do", "fi", "gu", "ke", "lo") for b in ("m", "n", "r", "s", "t", "v") for c in ("ax", "ep", "iq", "ob", "uz")]
    rows = [(" ".join(words), 1.0)] * 4 + [("a fine day", 0.0)] * 60
    features, _, weights = toxicity.fit(spark.createDataFrame(rows, "text string, y double"), toxicity.character_model(np.ones(28 ** 4, np.int64)))
    assert set(words) <= set(features) and len(features) > 512 and len(weights) == len(features)


@pytest.mark.parametrize("name,op", [("toxic", toxicity.score), ("quality", quality.score)])
def test_classifiers_on_odd_rows(odd, rows, no_rows, spark, name, op):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (None, 1), (8, None), (100, 0), (101, 0)], f"doc_id bigint, {name} int")
    out = op(odd, labels, F.col("doc_id") < 1000).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert ordered(str(r["doc_id"]) for r in out) == ordered(str(k) for k, *_ in rows)
    bare = op(odd, labels.filter("false"), F.lit(True)).collect()
    assert {round(r["score"], 9) for r in bare} == {0.5}
    assert op(no_rows, labels, F.lit(True)).count() == 0


def test_accepted_documents_keep_their_columns(odd, rows, spark):
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id bigint, toxic int")
    out = toxicity.accepted(odd, labels, F.lit(True))
    assert out.columns == odd.columns and out.count() <= len(rows)


def test_words_that_a_worker_knows_outlive_a_task(spark):
    path = public_tokenizers.path("word_bpe_49k.json")

    def run(batches):
        import os

        import pyarrow as pa

        for _ in batches:
            encode = tokens.kept_encoder(path)
            before = encode.used
            list(encode(pa.array(["some words of a text"]), 2))
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([before])], names=["pid", "before"])

    rows = spark.range(64, numPartitions=64).mapInArrow(run, "pid bigint, before bigint").collect()
    assert len(rows) == 64 and sum(r.before == 0 for r in rows) <= len({r.pid for r in rows}) < 64


def test_an_idle_worker_lets_go_of_its_encoder():
    import time

    import tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    first = tokens.kept_encoder(path)
    tokens.drop_when_idle(60)
    assert tokens.kept_encoder(path) is first and "timer" not in tokenizers._simloom_encoders
    tokens.drop_when_idle(0.05)
    for _ in range(100):
        if not tokenizers._simloom_encoders:
            break
        time.sleep(0.05)
    assert not tokenizers._simloom_encoders
    again = tokens.kept_encoder(path)
    assert again is not first and [x.tolist() for x, _ in again(pa.array(["some words"]), 2)] == [x.tolist() for x, _ in first(pa.array(["some words"]), 2)]
    tokens.drop_when_idle(0)


def test_only_texts_pass_python_when_documents_are_scored(spark):
    docs = spark.createDataFrame([(1, "a text", "x"), (2, None, None)], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    plan = toxicity.accepted(docs, labels, F.lit(True))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    assert plan.count("ArrowEvalPython") == 1


def test_encoder_holds_little_beside_its_words():
    import tracemalloc

    texts = [" ".join(f"{(i * 977 + j) * 2654435761 % (1 << 31):x}" for j in range(300)) for i in range(800)]
    encode = tokens.WordEncoder(path := public_tokenizers.path("word_bpe_49k.json"))
    tracemalloc.start()
    try:
        encode.clear()
        found = [(zlib.crc32(ids.tobytes()), n.sum()) for ids, n in encode(pa.array(texts), 2)]
        assert tracemalloc.get_traced_memory()[1] < 110e6  # 35 MB of places, 19 MB of ids at most, and the pieces' own
    finally:
        tracemalloc.stop()
    library, ids = Tokenizer.from_file(path), []
    for t in texts:
        ids += [*library.encode(t, add_special_tokens=False).ids, 2]
    assert len(found) > 4 and sum(n for _, n in found) == len(ids)
    again = np.concatenate([x for x, _ in encode(pa.array(texts), 2)])
    assert again.dtype == np.uint32 and again.tolist() == ids
