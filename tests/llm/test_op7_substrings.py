import random
import tracemalloc

import numpy as np
from brute import without_repeats

from tessera.llm import op7_substrings, shared
from tessera.llm.packing import pack, unpack


def check(spark, docs, size, **settings):
    got = op7_substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), size, **settings)
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(without_repeats(docs, size))


def test_against_brute_force(spark):
    for seed, size in ((1, 3), (2, 35)):
        r = random.Random(seed)
        passages = [[f"p{j}{i}" for i in range(r.randint(size, size + 30))] for j in range(5)]
        docs = []
        for i in range(150):
            w = []
            for _ in range(r.randint(0, 4)):
                w += r.choice(passages) if r.random() < 0.4 else [f"u{r.randrange(10**6)}" for _ in range(r.randint(1, 40))]
            docs.append((i, r.choice([" ", "\n", "\t\x0b"]).join(w)))
        docs += [(500, "same " * 100), (501, "same " * (size - 1)), (502, None), (503, ""), (504, "é x " * 50)]
        check(spark, docs, size)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = [(1, text), (1, text), (2, "x " + text)]
    check(spark, docs, 35)
    assert op7_substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(None, text, "a", 3)], "doc_id long, text string, kept string, bucket int")
    assert op7_substrings.remove_repeats(rows).first()["n_removed"] == 0


def test_sketch_loses_nothing(spark, monkeypatch):
    """Also where nearly all cells are shared, and however chunks and ranges lie."""
    r = random.Random(3)
    docs = [(i, " ".join(str(r.randrange(6)) for _ in range(60))) for i in range(60)]
    monkeypatch.setattr(op7_substrings, "LEAST_BITS", 1)
    monkeypatch.setattr(op7_substrings, "BYTES_A_CELL", 10**6)
    check(spark, docs, 5, chunk=500, ranges=8)


def test_same_at_any_size(spark):
    """Chunks and ranges as many as for an input of any size give the same as one of each."""
    r = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [(i if i % 5 else None, " ".join(f"u{r.randrange(10**6)}" for _ in range(r.randint(0, 60))) + f" {passage} " * (i % 3 == 0)) for i in range(200)] + [(900, f"{passage} " * 3000)]
    want = sorted(without_repeats(docs, 35), key=str)
    for chunk, ranges in ((300, 256), (10**9, 1)):
        got = op7_substrings.remove_repeats(spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id long, text string, data string, chunk int"), chunk=chunk, ranges=ranges)
        assert sorted((tuple(x)[:4] for x in got.collect()), key=str) == want


def test_prefilter_filters():
    """With the sketch as large as for production, few single windows pass it."""
    words = [[str(i).encode() for i in range(j * 3000, j * 3000 + 2000)] for j in range(100)]
    found, _, _ = op7_substrings.windows(words, 35)
    bits = (sum(len(w) * 6 for w in words) // op7_substrings.BYTES_A_CELL).bit_length()
    cells = [op7_substrings.Cells(found, r, 1, bits) for r in range(op7_substrings.ROWS)]
    passed = cells[0].of_windows(cells[0].lengths > 1) & cells[1].of_windows(cells[1].lengths > 1)
    assert len(set(found.tolist())) == len(found) and passed.mean() < 0.2


def test_white_space_stays(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"a\n\nb {passage}\nc\td\n"), (2, f"{passage}"), (3, f"x\n{passage} "), (4, " as it\nis ")]
    got = {r["doc_id"]: r["kept"] for r in op7_substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "a\n\nb c\td\n", 2: "", 3: "x\n", 4: " as it\nis "}


def test_packing():
    r = np.random.default_rng(0)
    arrays = [r.integers(0, 2**63, 50).astype(np.uint64), np.arange(9, dtype=np.uint32)[::-1].copy(), np.empty(0, np.uint32), r.integers(-5, 5, 7), np.array([1, 2], np.uint8)]
    for a, b in zip(arrays, unpack(pack(*arrays))):
        assert a.dtype == b.dtype and (a == b).all()


def test_words_are_not_kept():
    """A worker holds nothing of the words that it has hashed."""
    tracemalloc.start()
    found = shared.hashed_words([b"w%d" % i for i in range(50_000)])
    assert len(set(found.tolist())) == len(found) and shared.hashed_words([b"w7"])[0] == found[7]
    del found
    kept, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 1_000_000


def test_memory_goes_back_after_each_group(monkeypatch):
    calls = []
    monkeypatch.setattr(shared, "give_back", lambda: calls.append(1))
    run = shared.tidy_cogroup(lambda left, right: left + right)
    assert run(1, 2) + run(3, 4) == 10 and len(calls) == 2
