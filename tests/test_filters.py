"""Filters against a plain Python reading of the same JSON, on rows with nulls, in both null models."""

import random
import re

import pytest

from tessera.errors import QueryError
from tessera.plans.filters import Filters, apply_filter, regex_source

ROWS = [(i, [None, 1, 2, 3][i % 4], [None, "aa", "Ab", "b"][i // 4 % 4], [None, 0.5, 2.5][i % 3]) for i in range(48)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, n int, s string, x double")


def leaf(v, op, w, document):
    """True, False or None (unknown)."""
    if op == "$exists":
        return (v is not None) == w
    if op in ("$eq", "$ne") and w is None:
        return (v is None) == (op == "$eq")
    if document:
        if op == "$eq":
            return v is not None and v == w
        if op == "$ne":
            return not (v is not None and v == w)
        if op in ("$in", "$nin"):
            return (v in w) == (op == "$in")
        if v is None:
            return False
    elif v is None:
        return None if op not in ("$in", "$nin") or w else op == "$nin"
    return {
        "$eq": lambda: v == w, "$ne": lambda: v != w, "$gt": lambda: v > w, "$gte": lambda: v >= w, "$lt": lambda: v < w, "$lte": lambda: v <= w,
        "$in": lambda: v in w, "$nin": lambda: v not in w, "$regex": lambda: re.search(w, str(v)) is not None,
    }[op]()


def both(values):
    return False if False in values else None if None in values else True


def either(values):
    return True if True in values else None if None in values else False


def holds(row, expr, document):
    out = []
    for k, v in expr.items():
        if k == "$and":
            out.append(both([holds(row, e, document) for e in v]))
        elif k == "$or":
            out.append(either([holds(row, e, document) for e in v]))
        elif k == "$not":
            inner = holds(row, v, document)
            out.append(not inner if inner is not None else document or None)
        else:
            conditions = v if isinstance(v, dict) else {"$eq": v}
            out.append(both([leaf(row[k], op, w, document) for op, w in conditions.items()]))
    return both(out)


def random_filter(r, depth=0):
    if depth < 2 and r.random() < 0.5:
        kind = r.choice(["$and", "$or", "$not"])
        return {kind: random_filter(r, depth + 1)} if kind == "$not" else {kind: [random_filter(r, depth + 1) for _ in range(r.randint(0, 3))]}
    field = r.choice(["n", "s", "x"])
    values = {"n": [0, 1, 2, 3], "s": ["aa", "Ab", "b", "zz"], "x": [0.5, 1.0, 2.5]}[field]
    op = r.choice(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists"] + ["$regex"] * (field == "s"))
    value = {"$in": lambda: r.sample(values, r.randint(0, 2)), "$nin": lambda: r.sample(values, r.randint(0, 2)), "$exists": lambda: r.random() < 0.5, "$regex": lambda: r.choice(["^a", "b$", "A"])}.get(op, lambda: r.choice([*values, None] if op in ("$eq", "$ne") else values))()
    return {field: {op: value}}


@pytest.mark.parametrize("document", [False, True])
def test_random_filters(rows, document):
    from pyspark.sql import functions as F

    r = random.Random(5)
    filters = [random_filter(r) for _ in range(60)]
    compiler = Filters(rows.schema, "document" if document else "sql")
    got = rows.select("id", *[F.coalesce(compiler.compile(f), F.lit(False)).alias(f"f{i}") for i, f in enumerate(filters)]).collect()
    for row in got:
        values = dict(zip(("id", "n", "s", "x"), ROWS[row["id"]]))
        for i, f in enumerate(filters):
            assert row[f"f{i}"] == (holds(values, f, document) is True), (f, values)


def test_regex_forms():
    assert regex_source("/a.b/i") == "(?i)a.b" and regex_source("a") == "a" and regex_source(re.compile("x", re.I | re.M)) == "(?im)x"


def test_errors(rows):
    for bad in ({"nope": 1}, {"n": {"$like": 1}}, {"$xor": []}):
        with pytest.raises(QueryError):
            Filters(rows.schema).compile(bad)


def test_long_lists_join(rows):
    assert apply_filter(rows, {"id": {"$in": list(range(10, 5000))}, "n": 1}).count() == sum(1 for i, n, _, _ in ROWS if i >= 10 and n == 1)


def test_pushdown(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = apply_filter(df, {"o_totalprice": {"$gt": 1000}, "o_orderstatus": "F"}).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000" in plan and "EqualTo(o_orderstatus,F)" in plan and "o_custkey" not in plan.split("ReadSchema")[1]
