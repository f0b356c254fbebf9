"""The corpus pipeline against a sequential version, and on odd tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from simloom.llm.registry import QUERIES, table

SF = "/root/testdata/sf0.001"
WORD, PLAIN = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def distinct(docs):
    """The smallest id of each group of texts linked by 0.8 of their five-word shingles; all texts without words."""
    sets = {}
    for key, (text, _) in docs.items():
        w = WORD.findall(lower(text))
        sets[key] = {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    least = {k: k for k in docs}

    def root(k):
        while least[k] != k:
            k = least[k]
        return k

    keys = sorted(docs)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {k: docs[k] for k in docs if root(k) == k}


def clean(docs, items):
    windows = {tuple(w[i:i + 13]) for w in (PLAIN.findall(lower(t)) for t in items) if w for i in range(max(len(w) - 12, 1))}
    sizes = {len(w) for w in windows}
    kept = {}
    for key, (text, source) in docs.items():
        w = PLAIN.findall(lower(text))
        hit = {p for n in sizes for s in range(len(w) - n + 1) if tuple(w[s:s + n]) in windows for p in range(s, s + n)}
        if not hit or 20 * len(hit) < len(w):
            kept[key] = (text, source)
    return kept


def mixed(docs):
    """Ids with the number of their copies."""
    size = {k: len(WORD.findall(t or "")) for k, (t, _) in docs.items()}
    total = defaultdict(int)
    for k, (_, source) in docs.items():
        total[source] += size[k]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    free, target, left = set(total), {}, 1.5 * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if 2 * total[s] <= level * weight[s]}
        target |= {s: 2 * total[s] for s in over} if over else {s: level * weight[s] for s in free}
        left -= sum(2 * total[s] for s in over)
        free = free - over if over else set()
    queue = []
    for source in total:
        through = 0
        for u, k in sorted((hashlib.md5(f"mix{k}".encode()).hexdigest(), k) for k, (_, s) in docs.items() if s == source and size[k]):
            through += size[k]
            queue += [((turn * total[source] + through) / target[source], u, k, turn) for turn in (0, 1)]
    spent, copies = 0, Counter()
    for _, _, k, _ in sorted(queue):
        spent += size[k]
        if spent <= 1.5 * sum(total.values()):
            copies[k] += 1
    return copies


def test_pipeline(spark):
    docs = {r["doc_id"]: (r["text"], r["source"]) for r in table(spark, SF, "documents").collect()}
    toxic = {r["doc_id"] for r in QUERIES["op1_toxicity"](spark, SF).filter("predicted = 1").collect()}
    docs = {k: v for k, v in docs.items() if k not in toxic}
    docs = clean(distinct(docs), [r["text"] for r in table(spark, SF, "benchmark").collect()])
    copies = mixed(docs)
    encoder = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want, start = Counter(), 0
    for key in sorted(copies):
        ids = np.array([*encoder.encode(docs[key][0] or "", add_special_tokens=False).ids, 2], "<u4")
        for _ in range(copies[key]):
            want[key, start, len(ids), zlib.crc32(ids.tobytes())] += 1
            start += len(ids)
    got = corpus_pipeline.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert Counter(map(tuple, got)) == want


def test_stages_return_documents(spark, odd, tmp_path):
    labels = spark.createDataFrame([(100 + i, i % 2, int(i % 7 == 0)) for i in range(60)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, "two words"), (None, None)], "item_id bigint, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns and 0 < out.count() <= 2 * odd.count()
        assert stage(spark, odd.filter("false"), str(tmp_path)).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, odd, str(tmp_path)).count() == odd.count() and last(spark, odd.filter("false"), str(tmp_path)).count() == 0
