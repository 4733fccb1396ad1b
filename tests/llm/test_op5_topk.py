import numpy as np

from tessera.llm import op5_topk


def brute(ids, x, q_ids, q, k):
    out = []
    for i, v in zip(q_ids, q):
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), int(j)) for j, w in zip(ids, x) if j != i)
        out.append([(j, -s) for s, j in scored[:k]])
    return out


def test_block_with_ties_and_large_values():
    r = np.random.default_rng(1)
    for scale, n, dim in ((2, 400, 6), (30, 300, 16), (10**6, 200, 4), (10**9, 150, 4)):
        x = r.integers(-scale, scale + 1, (n, dim))
        x[10:40] = x[5]
        ids = r.permutation(n)
        q = np.arange(0, n, 20)
        got = op5_topk.nra_block(ids, x, ids[q], x[q], 20)
        assert [[(int(a), int(b)) for a, b in zip(*g)] for g in got] == brute(ids, x, ids[q], x[q], 20)


def test_reading_stops_early():
    """Of the given vectors, all queries stop before the lists end, and none goes beyond 31/32 of them."""
    import duckdb

    x = np.floor(64 * np.array([r[0] for r in duckdb.sql("SELECT embedding FROM '/root/testdata/sf0.1/embeddings.parquet' ORDER BY vec_id").fetchall()])).astype(np.int64)
    ids, read = np.arange(len(x)), []
    got = op5_topk.nra_block(ids, x, ids[::20], x[::20], 20, read)
    assert len(read) == 100 and max(read) < 0.97 and np.median(read) <= 0.94
    scores = x[::20] @ x.T
    for q, (found, score) in zip(range(0, len(x), 20), got):
        assert (score == np.sort(np.delete(scores[q // 20], q))[::-1][:20]).all() and len(found) == 20


def test_repeated_ids_and_other_columns(spark):
    rows = [(1, [1, 0], 9, "x")] * 300 + [(2, [2, 1], 9, "x"), (20, [1, 1], 9, "x")]
    table = spark.createDataFrame(rows, "vec_id long, v array<long>, rank int, score string")
    got = op5_topk.top_k(table, table.where("vec_id = 20"), 4).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 3), (1, 1), (1, 1), (1, 1)]


def test_table(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(v) for v in r.normal(size=5)], 0) for i in range(130)] + [(200, None, 0), (220, [1.0, None, 0.0, 0.0, 0.0], 0), (240, [float("nan")] * 5, 0), (260, [float("inf")] * 5, 0), (20, [0.5] * 5, 1)]
    table = op5_topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"))
    got = {}
    for row in op5_topk.top_k(table, table.where("vec_id % 20 = 0"), 7).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    v = [(i, np.floor(np.array(e) * 64)) for i, e, _ in rows if e is not None and None not in e and np.isfinite(e).all()]
    want = brute([i for i, _ in v], [e for _, e in v], [0, 40, 60, 80, 100, 120], [dict(v[:130])[i] for i in (0, 40, 60, 80, 100, 120)], 7)
    for q, w in zip((0, 40, 60, 80, 100, 120), want):
        assert [(j, s) for _, j, s in sorted(got[q])] == w
    assert len(got[20]) == 7  # rows with one id are one query's rows
    empty = spark.createDataFrame([], "vec_id long, v array<long>")
    assert op5_topk.top_k(empty, empty).count() == 0
