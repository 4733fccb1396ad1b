import random

import numpy as np
from brute import classes

from tessera.llm import op2_jaccard, shared


def corpus(seed, n=160):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [f"p{i}" for i in range(30)]
    docs = []
    for i in range(n):
        kind = r.random()
        if docs and kind < 0.5:
            w = r.choice(docs).split()
            for _ in range(r.randint(0, 3)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
            docs.append(" ".join(w))
        elif kind < 0.6:
            docs.append(r.choice(["", "one", "One two", "a b c d", "A B C D e", " ", "x\x1cy"]))
        else:
            w = [r.choice(vocabulary) for _ in range(r.randint(3, 60))]
            docs.append(" ".join(w + passage * (r.random() < 0.4)))
    return list(enumerate(docs))


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        got = op2_jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string"))
        assert sorted(map(tuple, got.collect())) == sorted(classes(docs))


def test_threshold_is_inclusive(spark):
    a = " ".join(f"w{i}" for i in range(11))  # 7 shingles; with one word less, 6 of 7 ... with two changed ends, fewer
    docs = [(5, a), (3, " ".join(a.split()[:-1])), (9, " ".join(a.split()[:-3]))]
    got = {r["doc_id"]: r["component_id"] for r in op2_jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: c for i, _, c in classes(docs)}


def test_odd_rows(spark):
    rows = [(1, "a b c", "k"), (1, "a b c", "k"), (None, "a b c", None), (4, None, None), (7, "", "z"), (8, "A b  c\n", "z")]
    got = op2_jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string, sid string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 1, 1), (1, 1, 1), (None, 1, None), (4, 0, 4), (7, 0, 7), (8, 1, 1)], key=str)
    assert op2_jaccard.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_tokens_labels_and_copies(spark, monkeypatch):
    """Many sets with one token, many near copies and many exact ones, spread over many tasks."""
    monkeypatch.setattr(op2_jaccard, "TOGETHER", 5)
    monkeypatch.setattr(shared, "HOT_ROWS", 6)
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(60):
        w = list(base)
        w[r.randrange(60)] = f"v{i}"
        docs.append(" ".join(w))
    docs += ["exact copy of these six words"] * 40
    docs += ["a b c d e " + " ".join(f"u{i}x{j}" for j in range(r.randint(3, 12))) for i in range(40)]
    docs += ["long " + " ".join(f"x{i}" for i in range(30_000))] * 2
    docs = list(enumerate(docs))
    r.shuffle(docs)
    got = op2_jaccard.classes(spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, part int, label int"))
    assert sorted(map(tuple, got.collect())) == sorted(classes(docs))
    monkeypatch.setattr(op2_jaccard, "CHUNK", 40)
    got = op2_jaccard.classes(spark.createDataFrame(docs[:150], "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(classes(docs[:150]))


def test_prefix_is_as_long_as_its_l():
    tokens = np.sort(np.random.default_rng(0).integers(0, 2**63, 40).astype(np.uint64))
    for counts in (np.full(40, 2), np.full(40, 5000), np.arange(1, 41) ** 2):
        found, chosen = op2_jaccard.prefix(tokens, tokens, counts.astype(np.int64), 75)
        assert len(found) == 40 - 30 + chosen


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (-5, 100)]
    labels = {r["sid"]: r["label"] for r in op2_jaccard.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert all(labels[i] == 0 for i in range(41)) and all(labels[i] == -5 for i in (100, 101, 102))
