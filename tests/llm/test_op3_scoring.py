import math
import zlib
from collections import Counter

import numpy as np
from brute import lower, words

from tessera.llm import op3_scoring


def test_base_score_is_exact(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(100_001, None), (100_002, "unseenword")]
    got = {r["doc_id"]: r for r in op3_scoring.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    tokens = {i: [*words(lower(t)), None] for i, t in docs}
    count = Counter(x for i in tokens if not held[i] for x in tokens[i])
    total, distinct = sum(count.values()), len(count)
    for i, t in tokens.items():
        r = got[i]
        base = sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(count[x] > 0 for x in t), total)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and math.isfinite(r["score"]) and r["score"] < 0
    out = [got[i] for i in held if held[i]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_filter_never_underestimates(spark):
    hashes = np.random.default_rng(0).integers(0, 2**63, 3000).astype(np.uint64)
    counts = np.arange(1, 3001)
    level, bits = op3_scoring.level_of(counts), 1 << 18
    on = np.zeros(bits, np.uint8)
    for q in range(1, int(level.max()) + 1):
        for place in op3_scoring.LogBloom.places(hashes[level >= q], q, bits):
            on[place] = 1
    found = op3_scoring.LogBloom(np.packbits(on, bitorder="little"), 1).levels(hashes)
    assert (found >= level).all() and (found > level).mean() < 0.2


def test_empty_and_repeated(spark):
    assert op3_scoring.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b", 1), (3, "a b", 2), (3, "a b", 2)]
    got = op3_scoring.score(spark.createDataFrame(rows, "doc_id long, text string, score long")).collect()
    assert len(got) == 3 and sum(r["doc_id"] == 3 for r in got) == 2 and not any(r["held_out"] for r in got if r["doc_id"] is None)


def model(docs):
    """The smoothed model with quantised counts, in plain Python; p(u, v, w)."""
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    tokens = {i: ["<", "<", *words(lower(t)), ">"] for i, t in docs}
    learnt = [t for i, t in tokens.items() if not held[i]]
    word = Counter(x for t in learnt for x in t[2:])
    pair = Counter(x for t in learnt for x in zip(t[1:], t[2:])) + Counter({("<", "<"): len(learnt)})
    triple = Counter(x for t in learnt for x in zip(t, t[1:], t[2:]))
    word["<"] = len(learnt)
    total = sum(n for x, n in word.items() if x != "<")
    levels = sorted({1 << k for k in range(20)} | {3 << k for k in range(20)})

    def least(n):
        return max((x for x in levels if x <= n), default=0)

    def most(n):
        return min(x for x in levels if x > n) - 1 if n else 0

    def p(u, v, w):
        lm = op3_scoring
        a = lm.SHARE * word[v] / (word[v] + lm.MU_PAIR)
        out = a * least(pair[v, w]) / max(word[v], 1) + (1 - a) * (word[w] + 1) / (total + len(word))
        c = word["<"] if v == "<" else most(pair[u, v])
        b = lm.SHARE * c / (c + lm.MU_TRIPLE)
        return b * min(least(triple[u, v, w]), c) / max(c, 1) + (1 - b) * out

    return p, tokens, word


def corpus():
    return [(i, " ".join(f"w{(i * 7 + j * (1 + i % 5)) % 400}" for j in range(40))) for i in range(300)]


def check_scores(spark, docs):
    p, tokens, _ = model(docs)
    got = {r["doc_id"]: r["score"] for r in op3_scoring.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {i: sum(math.log10(p(*x)) for x in zip(t, t[1:], t[2:])) for i, t in tokens.items()}
    off = [abs(got[i] - want[i]) / abs(want[i]) for i in want]  # the filter's false hits
    assert max(off) < 0.15 and sum(off) / len(off) < 0.02


def test_score_against_model(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_scores(spark, docs + [(100_001, None), (100_002, "unseenword")])


def test_same_at_any_size(spark, monkeypatch):
    """With as many chunks and ranges as for a far larger input; the rarest n-grams count too."""
    check_scores(spark, corpus())
    monkeypatch.setattr(op3_scoring, "CHUNK", 50)
    monkeypatch.setattr(op3_scoring, "PART_BYTES", 200)
    check_scores(spark, corpus())


def test_probabilities_sum_to_at_most_one():
    p, tokens, word = model(corpus())
    for u, v in {x for t in list(tokens.values())[:40] for x in zip(t, t[1:]) if x[1] != ">"}:
        assert sum(p(u, v, w) for w in word if w != "<") <= 1 + 1e-9
