"""Helpers that several operators share: shared storage and word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import io
import uuid
import zipfile
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in every contract of this package: ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Hash ranges at most: at 100 TB a range then answers for 1.5 GB of text.
MOST_RANGES = 1 << 16
#: Rows beyond which a join key is hot, at least, and the most keys that can be.
HOT_ROWS, MOST_HOT = 1000, 10_000
#: Spark's setting that a query's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an Arrow batch at most; bytes beyond which a batch takes no further row.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, one in the session's warehouse, which executors share too."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessera"
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes a table to the shared folder and rereads it, which cuts its lineage; also returns its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # the table is whole; nothing needs the shuffles that made it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that :func:`written` made and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a cluster, so that it needn't be installed there.

    Also bounds the session's Arrow batches, whose rows are whole texts here.
    """
    sc = spark.sparkContext
    for key, most in ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES):
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))
    if getattr(sc, "_tessera_shipped", False):
        return
    root, data = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    path = f"{shared_dir(spark)}/code/{uuid.uuid4().hex}/tessera.zip"
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(bytearray(data.getvalue()))
    finally:
        out.close()
    sc.addPyFile(path)
    sc._tessera_shipped = True


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text_size(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def hash_ranges(size: int, part_bytes: int) -> int:
    """How many hash ranges, a power of two, to deal the entries of ``size`` bytes of text to.

    Each chunk of documents sends a message to each range, so chunks grow too
    (:func:`chunk_bytes`), and beyond ``MOST_RANGES`` ranges grow instead of their number.
    """
    return min(MOST_RANGES, 1 << max(4, (size // part_bytes).bit_length()))


def chunk_bytes(size: int, least: int) -> int:
    """Text bytes of a chunk: ``least``, and for inputs of over 10 000 such chunks up to eight times as much."""
    return min(8 * least, max(least, size // 10_000))


def hot_keys(df: DataFrame, key: str) -> dict[int, int]:
    """The keys with very many rows and into how many parts to spread each; ``MOST_HOT`` keys at most, as each has more than rows / ``MOST_HOT``."""
    bound = max(HOT_ROWS, df.count() // MOST_HOT)
    many = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound)
    return {r[key]: -(-r["n"] // bound) for r in many.collect()}


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: dict[int, int] | None = None) -> DataFrame:
    """Joins on a column (long) that the right side holds once for each value; a hot key's rows on the left go to many tasks."""
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    parts = F.broadcast(left.sparkSession.createDataFrame(list(hot.items()), "hot_key long, hot_parts int"))
    spread = lambda df: df.join(parts, df[key] == F.col("hot_key"), "left").drop("hot_key")
    own = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.coalesce("hot_parts", F.lit(1))).cast("int")
    salted = spread(left).withColumn("hot_part", own).drop("hot_parts")
    copies = spread(right).withColumn("hot_part", F.explode(F.sequence(F.lit(0), F.coalesce("hot_parts", F.lit(1)) - 1))).drop("hot_parts")
    return salted.join(copies, [key, "hot_part"], how).drop("hot_part")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def as_text(df: DataFrame, column: str = "text"):
    """A text column in which null is the empty text."""
    return F.coalesce(df[column], F.lit(""))


def hashed_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words.  Hashing takes less time than to look words up, so none are kept."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (that of splitmix64), so that any bits of the result may be used."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CACHES: dict[str, object] = {}


def claim(name: str, clear=lambda: None) -> None:
    """Says whose caches a worker is to hold from now on; those of other operators are cleared.

    Spark reuses its Python workers, so that without this a pipeline's workers
    would hold the caches of all its stages.
    """
    if len(_CACHES) == 1 and name in _CACHES:
        return
    others = [_CACHES.pop(other) for other in list(_CACHES) if other != name]
    _CACHES[name] = clear
    for f in others:
        f()
    if others:
        gc.collect()
        give_back()


def give_back() -> None:
    """Returns to the system what a worker has freed, which the allocators would keep from the JVM beside it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A function over Arrow batches after which its worker, idle from then on, holds no freed memory."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def tidy_cogroup(run):
    """A function over two groups after each of which its worker holds no freed memory, as a task's end isn't known to it."""

    def tidied(left, right):
        try:
            return run(left, right)
        finally:
            give_back()

    return tidied


def text_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]
