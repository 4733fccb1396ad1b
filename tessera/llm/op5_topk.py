"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Each dimension of a block of vectors is a list sorted by component; a query reads
it from the end that its own component favours.  Lists are read sequentially and
in step, to a half, then three quarters, and on, the unread rest halving each time.
After each step every vector that may still qualify has a lower bound (its unread
components count as the worst value of their list) and an upper bound (they count as
the value at the frontier).  A vector whose upper bound is below the k-th lower bound
is an outsider for good; bounds are only kept for the others.  Reading stops as soon
as few are left; their scores are then resolved.  While most vectors may still
qualify, the bounds of all queries of a block are matrix products; later each query
goes on over its own candidates.

Blocks of queries meet blocks of vectors by an equi-join on the pair of block
numbers: no block, and no list of partial results, grows with the table.

Defined results: null vectors and vectors with null or non-finite components take
no part; vectors of another length than the query's are not its candidates; rows
that share the query's id count as its own; ties go to the smaller id, repeated
candidate rows count once each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import ship

#: Vectors and queries of a block.
BLOCK, QUERY_BLOCK = 8192, 512
#: Reading stops when at most so many times k candidates are left.
OPEN = 3
#: Share of a block below which a query's candidates are bounded by themselves.
FEW = 0.125


def depths(n: int) -> Iterator[int]:
    """How many entries of each list of ``n`` have been read after each step; all in the end."""
    unread = n
    while unread > 1:
        unread //= 2
        yield n - unread
    yield n


def nra_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, read: list[float] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """The k best (ids, scores) of each query among the integer vectors ``x``.

    ``read``, if given, gets the share of the lists that each query has read.
    """
    reach = float((np.abs(x).max(axis=0, initial=0).astype(float) * np.abs(q).max(axis=0, initial=0)).sum())
    # Sums of whole numbers are exact in these types; beyond, in Python's own integers.
    kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else object
    n, x, q = len(ids), x.astype(kind), q.astype(kind)
    signs = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
    lists = np.sort(x, axis=0)
    live = query_ids[:, None] != ids[None, :]
    counts = live.sum(axis=1)
    share = np.zeros(len(q))
    for depth in depths(n):
        going = np.flatnonzero(counts > OPEN * k)
        if not len(going):
            break
        top, bottom = lists[n - depth], lists[depth - 1]  # frontiers when reading downwards and upwards

        def bounds(rows: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            lower = np.concatenate([np.where(rows >= top, rows, lists[0]), np.where(rows <= bottom, rows, lists[-1])], axis=1)
            upper = np.concatenate([np.maximum(rows, top), np.minimum(rows, bottom)], axis=1)
            return signs[of] @ lower.T, signs[of] @ upper.T

        share[going] = depth / n
        many = going[counts[going] > FEW * n]
        if len(many):
            lower, upper = bounds(x, many)
            lower = np.where(live[many], lower, -np.inf)
            live[many] &= upper >= np.sort(lower, axis=1)[:, -k][:, None] if kind is object else upper >= np.partition(lower, n - k, axis=1)[:, n - k][:, None]
        for i in going[counts[going] <= FEW * n]:
            at = np.flatnonzero(live[i])
            lower, upper = (b[0] for b in bounds(x[at], np.array([i])))
            live[i, at[upper < np.sort(lower)[-k]]] = False
        counts = live.sum(axis=1)
    if read is not None:
        read.extend(share.tolist())
    left = (np.flatnonzero(row) for row in live)
    return [_best(ids, x[at] @ q[i], k, at) for i, at in enumerate(left)]


def _best(ids: np.ndarray, scores: np.ndarray, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.array(sorted(range(len(at)), key=lambda i: (-scores[i], ids[at[i]])), int) if scores.dtype == object else np.lexsort((ids[at], -scores))
    order = order[:k]
    return ids[at[order]], scores[order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` vectors with the highest inner product for each query.

    Both tables have vec_id and an integer vector ``v`` (array<long>).  Returns
    query_id, rank, vec_id and score.
    """
    ship(vectors.sparkSession)
    ready = lambda df: df.where(F.col("vec_id").isNotNull()).select("vec_id", "v", F.size("v").alias("dim"))
    vectors, queries = ready(vectors), ready(queries)
    of = lambda df, size: max(1, -(-df.count() // size))
    n_rows, n_queries = of(vectors, BLOCK), of(queries, QUERY_BLOCK)

    def packed(df: DataFrame, name: str, blocks: int, other: str, others: int) -> DataFrame:
        # By row, not by id: rows that share an id don't share a block.
        by = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
        whole = df.withColumn(name, by).groupBy("dim", name).agg(F.collect_list(F.struct("vec_id", "v")).alias(f"{name}s"))
        return whole.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    pairs = packed(vectors, "row", n_rows, "query", n_queries).join(packed(queries, "query", n_queries, "row", n_rows).hint("shuffle_hash"), ["dim", "row", "query"])
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def unpacked(column: pa.Array, i: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
        whole = column[i].values
        v = whole.field("v").flatten()
        return whole.field("vec_id").to_numpy(zero_copy_only=False), v.to_numpy(zero_copy_only=False).reshape(len(whole), dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                ids, x = unpacked(batch.column(1), i, dim)
                query_ids, q = unpacked(batch.column(2), i, dim)
                found = nra_block(ids, x, query_ids, q, k)
                sizes = [len(a) for a, _ in found]
                if sum(sizes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, sizes)), pa.array(np.concatenate([a for a, _ in found])), pa.array(np.concatenate([s for _, s in found]).astype(np.int64))], schema=schema)

    best = pairs.select("dim", "rows", "querys").mapInArrow(run, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and floor(scale * x) of each component; only whole, finite vectors."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    ok = F.col("embedding").isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return embeddings.where(ok).select("vec_id", F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every vector for those whose id is divisible by 20."""
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


QUERIES = {"op5_topk": op5_topk}
ORACLE_SQL = {
    "op5_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
}
