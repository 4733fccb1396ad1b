import math
import random
from collections import defaultdict

from brute import mix_targets, words
from pyspark.sql import functions as F

from tessera.llm import op8_mixing


def checked(spark, docs):
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = op8_mixing.mix(table).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for _, t, s in docs:
        sizes[s] += len(words(t))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(d["words"] for d in r["draws"])
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = mix_targets(dict(sizes))
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s]) and abs(taken[s] - target[s]) <= 1
    assert len(got) == len(docs)
    return table, got


def test_targets_and_quotas(spark):
    r = random.Random(4)
    docs = [(i, "w " * int(r.expovariate(1 / 60)), r.choice(["a", "b", "c", "Z", "é", None, "a", "a"])) for i in range(900)]
    table, got = checked(spark, docs)
    assert sorted(map(tuple, op8_mixing.mix(table).drop("draws").collect()), key=str) == sorted((tuple(x)[:-1] for x in got), key=str)


def test_odd_rows(spark):
    checked(spark, [(1, "a b c", "x"), (1, "a b c", "x"), (None, None, "y"), (3, "", None), (4, "long " * 5000, "z")])
    assert op8_mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string, draws string")).count() == 0


def test_tree_deals_quotas(spark):
    quota = {"a": 37, "b": 200, "c": 1, "d": 0}
    table = spark.createDataFrame(list(quota.items()), "skey string, slots long")
    rows = op8_mixing.split_tree(table, 3, 1).collect()
    shards, at = defaultdict(int), defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["skey"], r["shard"])):
        assert r["lo"] == at[r["skey"]] < r["hi"]  # disjoint runs that follow each other
        at[r["skey"]] = r["hi"]
        shards[r["shard"]] += r["hi"] - r["lo"]
    assert dict(at) == {s: n for s, n in quota.items() if n}
    assert sorted(shards) == list(range(8)) and set(shards.values()) <= {29, 30}


def test_draws_are_hypergeometric(spark):
    """Against the exact probabilities of 7 of 20, of which 9 are ours."""
    n = 4000
    u = (F.col("id") + 0.5) / n
    long = lambda x: F.lit(x).cast("long")
    got = spark.range(n).select(op8_mixing.hypergeometric(long(9), long(20), long(7), u).alias("x")).groupBy("x").count().collect()
    want = {x: math.comb(9, x) * math.comb(11, 7 - x) / math.comb(20, 7) for x in range(8)}
    for r in got:
        assert abs(r["count"] / n - want.pop(r["x"])) < 1.5 / n + 1e-9
    assert all(p < 1 / n for p in want.values())


def test_permuted_is_a_bijection(spark):
    for bits in (6, 7, 13):
        got = spark.range(1 << bits).select(op8_mixing.permuted(F.col("id"), F.lit(bits), F.lit(5)).alias("p"))
        assert sorted(r["p"] for r in got.collect()) == list(range(1 << bits)) != [r["p"] for r in got.collect()]


def test_many_blocks_and_shards(spark):
    r = random.Random(5)
    docs = [(i, "w " * r.randrange(40), "hot" if i % 3 else r.choice("abc")) for i in range(600)] + [(7, "w " * 9, "hot")] * 60
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = op8_mixing.mix(table, block_words=4, shard_words=300, carry=("text",)).collect()
    sizes, taken, target, shards = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for row in got:
        assert row["size"] == len(words(row["text"])) and row["taken"] == sum(d["words"] for d in row["draws"])
        sizes[row["source"]] += row["size"]
        taken[row["source"]] += row["taken"]
        target[row["source"]] = row["target"]
        for d in row["draws"]:
            shards[d["shard"]] += d["words"]
    assert len(got) == len(docs) and all(abs(taken[s] - target[s]) <= 1 for s in sizes) and len(shards) == 64


def test_first_words(spark):
    got = spark.createDataFrame([(" a  b\nc d",)], "t string").select(*[op8_mixing.first_words(F.col("t"), F.lit(n)).alias(str(n)) for n in (1, 2, 3, 9)]).first()
    assert list(got) == [" a", " a  b", " a  b\nc", " a  b\nc d"]
