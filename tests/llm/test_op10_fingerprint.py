import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.llm import op10_fingerprint as op


def pieces(text):
    return set(re.findall(r"[^\n]{1,128}", text or ""))


def likeness(a, b):
    a, b = pieces(a), pieces(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def check(spark, docs):
    rows = sorted(docs)
    got = {r["doc_id"]: r for r in op.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, (doc_id, text) in enumerate(rows):
        text, nxt = text or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + nxt[:q]
        r = got[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - likeness(text, edited)) < 1e-9 and abs(r["near_next"] - likeness(text, nxt)) < 1e-9
        assert len(r["differing"]) == len(pieces(text) ^ pieces(edited))
    assert len(got) == len(docs)
    return got


def test_against_sets(spark):
    r = random.Random(6)
    lines = ["line %d %s" % (i, "é" * r.randint(0, 300)) for i in range(400)]
    docs = [(r.randrange(-(2**40), 2**40), "\n".join(r.choice(lines) for _ in range(r.choice([0, 1, 2, 5, 30, 200])))) for _ in range(60)]
    docs += [(i, "\n".join(lines[i : i + 5])) for i in range(20)] + [(5000, None), (5001, ""), (2**62, "x\n\n\ny")]
    got = check(spark, docs)
    assert got[5000]["fingerprint"] == got[5001]["fingerprint"]


def test_one_and_none(spark):
    got = check(spark, [(7, "only\none")])
    assert got[7]["near_next"] == 1.0
    assert op.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_odd_rows(spark):
    rows = [(1, "a", "k"), (1, "a", "k"), (None, "b", None), (2, "c", None)]
    got = op.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, keys string")).collect()
    assert len(got) == 4 and [r["near_next"] for r in got if r["doc_id"] is None] == [0.0]
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 1}) == 1


def test_peeling_recovers_or_says_so(spark):
    a, b = [list(range(0, 40)), list(range(20, 60))]
    df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    few = op.peel(op.subtract(op.sketch(F.col("a"), 4), op.sketch(F.col("b"), 4)), 4)
    many = op.peel(op.subtract(op.sketch(F.col("a"), 40), op.sketch(F.col("b"), 40)), 40)
    row = df.select(few.alias("few"), many.alias("many")).first()
    assert row["few"] is None and {(x["n"], x["key"]) for x in row["many"]} == {(1, i) for i in range(20)} | {(-1, i) for i in range(40, 60)}


def test_doubling_recovers_what_is_stuck(spark, monkeypatch):
    """With far too few cells at first, each group doubles them until it is recovered."""
    monkeypatch.setattr(op, "FIRST_CELLS", 1)
    rows = [(list(range(i, i + 9 * i)), list(range(2 * i, 12 * i))) for i in range(1, 15)]
    table = spark.createDataFrame(rows, "a array<long>, b array<long>")
    found = op.differing(F.col("a"), F.col("b"), op.sketch(F.col("a")), op.sketch(F.col("b")))
    for r in table.withColumn("found", found).collect():
        assert sorted((x["key"], x["n"]) for x in r["found"]) == sorted([(k, 1) for k in set(r["a"]) - set(r["b"])] + [(k, -1) for k in set(r["b"]) - set(r["a"])])


def test_very_long_text(spark):
    long = "\n".join(f"line {i} " + "x" * (i % 300) for i in range(4000))
    check(spark, [(1, long), (2, "short"), (3, long[1000:])])


def test_next_ids(spark):
    r = random.Random(7)
    ids = sorted({r.randrange(-(2**62), 2**62) for _ in range(50)} | set(range(1000, 1300)))
    found = {x["bucket"]: x["next_id"] for x in op.next_ids(spark.createDataFrame([(i,) for i in ids], "doc_id long"), bits=6).collect()}
    for bucket in {i >> 6 for i in ids}:
        later = [i for i in ids if i >> 6 > bucket]
        assert found[bucket] == (later[0] if later else ids[0])
