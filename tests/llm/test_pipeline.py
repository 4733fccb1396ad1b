import os
import sys
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as P
from brute import classes, mix_targets, without_repeats, words

from tessera.llm import op7_substrings
from tessera.llm.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    states = [docs.collect()]
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(P.STAGES) - 1:
            assert sorted(out.columns) == sorted(COLUMNS)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        states.append(docs.collect())
    start, named, single, cut, mixed, tokens = states
    assert {r["doc_id"] for r in named} == {r["doc_id"] for r in start if any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in single} == {i for i, _, c in classes([(r["doc_id"], r["text"]) for r in named]) if i == c}
    want = {i: (n, gone) for i, n, gone, _ in without_repeats([(r["doc_id"], r["text"]) for r in single])}
    got = {r["doc_id"]: r for r in cut}
    assert set(got) == {i for i, (n, gone) in want.items() if gone == 0 or gone < n}
    before = {r["doc_id"]: r["text"] for r in single}
    for i, r in got.items():
        assert r["text"] == before[i] if want[i][1] == 0 else len(words(r["text"])) == want[i][0] - want[i][1]
        assert r["n_chars"] == len(r["text"])
    assert {r["doc_id"] for r in mixed} <= set(got) and max(sum(1 for r in mixed if r["doc_id"] == i) for i in got) <= 2
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in cut:
        sizes[r["source"]] += len(words(r["text"]))
    for r in mixed:
        taken[r["source"]] += len(words(r["text"]))
        assert got[r["doc_id"]]["text"].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert all(abs(taken[s] - t) <= 1 for s, t in mix_targets(dict(sizes)).items())
    assert len(tokens) == len(mixed) and all(r["n_tokens"] > 0 for r in tokens)


def test_long_texts_and_other_columns(spark, sf_dir):
    """Columns named like those of the operators, and texts of a hundred thousand words."""
    rows = [(i, " ".join(f"wort{i}x{j}" for j in range(100_000 if i < 2 else 30)), "de", "a", 9, "x", 1, 2) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, draws long, lang_pred long")
    for _, stage in P.STAGES[:4]:
        docs, _ = written(stage(spark, docs, sf_dir), "test")
        assert sorted(docs.columns) == sorted(COLUMNS)
    found = [(r["doc_id"], len(words(r["text"]))) for r in docs.collect()]
    assert {i for i, _ in found} == set(range(6)) and abs(sum(n for _, n in found) - 1.5 * (200_000 + 120)) <= 1


def test_empty(spark, sf_dir):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_nulls_and_repeated_rows(spark, sf_dir):
    text = " ".join(f"wort{i}" for i in range(20))
    rows = [(1, text, "de", "a", 5), (1, text, "de", "a", 5), (None, "ohne nummer", None, None, None), (3, None, "de", "a", None), (4, "12 34", "de", None, 5), (5, text + " ende", "de", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = []
    for _, stage in P.STAGES[:3]:
        docs = stage(spark, docs, sf_dir)
        kept.append(sorted((r["doc_id"] for r in docs.collect()), key=str))
    assert kept == [[1, 1, 5, None], [1, None], [1, None]]


def test_passages_hold_texts_once(spark, sf_dir, monkeypatch):
    """What the stage stores and shuffles twice has no second copy of the texts; they come back as they were all the same."""
    seen, real = [], op7_substrings.chunks
    monkeypatch.setattr(op7_substrings, "chunks", lambda docs, size: seen.append(docs) or real(docs, size))
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" as it\n\nis ", None, "", f"a\n{passage}  b", f"c {passage}", passage]
    docs = spark.createDataFrame([(i, t, "de", None, 9, 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, missing int")
    got = {r["doc_id"]: (r["text"], r["lang"], r["source"], r["n_chars"]) for r in P.repeated_passages(spark, docs, sf_dir).collect()}
    assert got == {0: (texts[0], "de", None, 11), 1: (None, "de", None, 0), 2: ("", "de", None, 0), 3: ("a\nb", "de", None, 3), 4: ("c ", "de", None, 2)}
    assert all(list(r).count(r["text"]) == 1 for r in seen[0].where("doc_id in (0, 3)").collect())


def test_near_duplicates_shuffles_texts_once(spark, sf_dir, monkeypatch):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, "a"), (None, "c")]
    docs, _ = written(spark.createDataFrame([(i, t, "de", "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), "test")
    found, _ = written(spark.createDataFrame([(1, 1), (1, 1), (1, 1), (2, 1)] + [(None, None)] * 3, "doc_id long, component_id long"), "test")
    monkeypatch.setattr(P.op2_jaccard, "classes", lambda docs: found)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = P.near_duplicates(spark, docs, sf_dir)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == [(1, "a"), (1, "b"), (None, "a"), (None, "c")]
    # One each for the texts with an id, those without, and the ids that stay.
    assert plan.count("Exchange hashpartitioning") == 3
