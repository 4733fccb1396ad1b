"""Document fingerprints: an invertible Bloom lookup sketch of hashed paragraphs.

A text's paragraphs (lines, long ones in pieces of ``PIECE`` code points) are
hashed to digests.  Each digest goes to one cell of each of three subtables; a
cell holds the number of its digests, their exclusive or, and that of their check
hashes.  Subtracting the cells of two versions leaves the digests in which they
differ, and peeling (taking out cells that hold one digest) recovers these.  If
peeling gets stuck, both versions are sketched again, larger: the digests are
dealt by hash to groups of about ``GROUP``, each with a sketch of its own, so the
work stays in proportion to the text however long it is.  A group that gets stuck is
tried again by itself, with another hash and twice the cells, until it is recovered.

All of it is DataFrame operations on the JVM.

Defined results: a null text is empty and has the empty sketch; equal texts have
equal fingerprints; likeness is 2 * common / (n + m) of the two digest sets, 1.0
for two empty ones; with one document, the next is the document itself; a row
with a null id has no next document, is its own edited text and has likeness 0 to
the next; rows with one id follow each other by a hash of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import documents, let, written

#: Code points of a piece of a paragraph; cells of a subtable of the fingerprint.
PIECE, CELLS = 128, 8
#: Digests of a group, the cells of its subtables in the first try, and how often they may double.
GROUP, FIRST_CELLS, DOUBLINGS = 24, 14, 16
#: Rounds of peeling; each takes out all cells that hold one digest.
ROUNDS = 12
#: Documents of a bucket when looking for the next document, as a power of two.
BUCKET_BITS = 9


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"[^\\n]{{1,{PIECE}}}"), F.lit(0)), lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(7)).bitwiseAND(F.lit(0xFFFFFFFF))


def _col(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _place(spread: Column, table: int, cells: Column) -> Column:
    return F.pmod(F.shiftright(spread, 20 * table), cells)


def sketch(keys: Column, cells: Column | int = CELLS, seed: Column | int = 0) -> Column:
    """The three subtables of a digest set, as one array of (n, key, check)."""
    cells, seed = _col(cells), _col(seed)
    entry = lambda d: F.struct(d.alias("key"), F.xxhash64(d, seed).alias("spread"), _check(d).alias("check"))
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("check"))

    def subtable(entries: Column, table: int) -> Column:
        placed = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["check"].alias("check"), _place(e["spread"], table, cells).alias("at")))
        put = lambda i: lambda held, e: F.when(e["at"] == i, F.struct((held["n"] + 1).alias("n"), held["key"].bitwiseXOR(e["key"]).alias("key"), held["check"].bitwiseXOR(e["check"]).alias("check"))).otherwise(held)
        return let(placed, lambda p: F.transform(F.sequence(F.lit(0), cells - 1), lambda i: F.aggregate(p, empty, put(i))))

    return let(F.transform(keys, entry), lambda entries: F.concat(*[subtable(entries, t) for t in range(3)]))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["check"].bitwiseXOR(y["check"]).alias("check")))


def peel(cells: Column, width: Column | int = CELLS, seed: Column | int = 0) -> Column:
    """The digests left in a difference, with their sign (1: only in the first), or null if peeling gets stuck."""
    pure = lambda held: F.array_distinct(F.transform(F.filter(held["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["check"] == _check(c["key"]))), lambda c: F.struct(c["n"].alias("n"), c["key"].alias("key"))))
    width, seed = _col(width), _col(seed)

    def without(cells: Column, found: Column) -> Column:
        at = lambda p, t: _place(F.xxhash64(p["key"], seed), t, width) + width * t
        spread = F.transform(found, lambda p: F.struct(p["n"].alias("n"), p["key"].alias("key"), _check(p["key"]).alias("check"), *[at(p, t).alias(f"at{t}") for t in range(3)]))
        take = lambda i: lambda held, p: F.when((p["at0"] == i) | (p["at1"] == i) | (p["at2"] == i), F.struct((held["n"] - p["n"]).alias("n"), held["key"].bitwiseXOR(p["key"]).alias("key"), held["check"].bitwiseXOR(p["check"]).alias("check"))).otherwise(held)
        return let(spread, lambda s: F.transform(cells, lambda c, i: F.aggregate(s, c, take(i))))

    def round_(held: Column, _: Column) -> Column:
        return F.when(held["over"], held).otherwise(let(pure(held), lambda found: F.when(F.size(found) == 0, F.struct(held["cells"].alias("cells"), held["found"].alias("found"), F.lit(True).alias("over"))).otherwise(F.struct(without(held["cells"], found).alias("cells"), F.concat(held["found"], found).alias("found"), F.lit(False).alias("over")))))

    none = F.lit(None).cast("array<struct<n:int,key:bigint>>")
    start = F.struct(cells.alias("cells"), F.coalesce(none, F.array().cast("array<struct<n:int,key:bigint>>")).alias("found"), F.lit(False).alias("over"))
    # An order that each round only reads: the number of a round is not used.
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda held, i: round_(held, i), lambda held: F.when(F.forall(held["cells"], lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["check"] == 0)), held["found"]))


def _recovered(a: Column, b: Column) -> Column:
    """The signed digests in which two sets differ, by sketches that double until peeling recovers them."""
    none = F.lit(None).cast("array<struct<n:int,key:bigint>>")

    def attempt(held: Column, k: Column) -> Column:
        size, seed = F.call_function("shiftleft", F.lit(FIRST_CELLS), k), k + 1
        return F.when(held.isNotNull(), held).otherwise(peel(subtract(sketch(a, size, seed), sketch(b, size, seed)), size, seed))

    failed = F.raise_error(F.lit("two digests share their cells under every hash")).cast("array<struct<n:int,key:bigint>>")
    return F.coalesce(F.aggregate(F.sequence(F.lit(0), F.lit(DOUBLINGS)), none, attempt), failed)


def differing(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """The digests in which two texts differ: from their fingerprints if these suffice, else from larger ones."""
    groups = F.greatest(F.lit(1), F.ceil((F.size(a) + F.size(b)) / GROUP)).cast("int")
    part = lambda keys, g: F.filter(keys, lambda d: F.pmod(F.xxhash64(d, F.lit(100)), groups) == g)
    each = F.transform(F.sequence(F.lit(0), groups - 1), lambda g: let(F.struct(part(a, g).alias("a"), part(b, g).alias("b")), lambda s: _recovered(s["a"], s["b"])))
    return F.coalesce(peel(subtract(cells_a, cells_b)), F.flatten(each))


def likeness(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise((total - F.size(differing(a, b, cells_a, cells_b))) / total)


def as_string(keys: Column, cells: Column) -> Column:
    """The fingerprint as text: the number of digests, then each cell's count, key and check in hex."""
    cell = lambda c: F.concat(F.lpad(F.hex(c["n"]), 4, "0"), F.lpad(F.hex(c["key"]), 16, "0"), F.lpad(F.hex(c["check"]), 8, "0"))
    return F.concat(F.hex(F.size(keys)), F.lit(":"), F.array_join(F.transform(cells, cell), ""))


def next_ids(ids: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """The first id after each bucket (bucket, next_id), wrapping round to the first of all.

    A bucket is an id without its last ``bits`` bits, so it holds so many ids at
    most.  Buckets are looked up in a tree of the same width: a bucket's next one
    is its next sibling's first, or else that of its parent.
    """
    ends = ids.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    nodes = ids.groupBy(F.shiftright("doc_id", bits).alias("k1")).agg(F.min("doc_id").alias("first"))
    if ends["lo"] is None:
        return nodes.select(F.col("k1").alias("bucket"), F.col("first").alias("next_id"))
    levels = []
    depth = 1
    while True:
        up, away = f"k{depth + 1}", bits * (depth + 1)
        # The root is above all ids; those below and above zero have no bits in common.
        root = away >= 64 or ends["lo"] >> away == ends["hi"] >> away
        nodes = nodes.withColumn(up, F.lit(0) if root else F.shiftright(f"k{depth}", bits))
        levels.append(nodes.withColumn("sibling", F.lead("first").over(W.partitionBy(up).orderBy(f"k{depth}"))))
        if root:
            break
        nodes = nodes.groupBy(up).agg(F.min("first").alias("first"))
        depth += 1
    found = levels[-1].select(f"k{depth}", F.coalesce("sibling", F.lit(ends["lo"])).alias("next_id"))
    for at in range(depth - 1, 0, -1):
        found = levels[at - 1].join(found, f"k{at + 1}").select(f"k{at}", F.coalesce("sibling", "next_id").alias("next_id"))
    return found.withColumnRenamed("k1", "bucket")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and their edited versions.

    The edited text has its last quarter replaced by the start of the next
    document's.  Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next and differing, the digests (with
    sign) in which text and edited text differ.
    """
    text = F.coalesce("text", F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    after, _ = written(next_ids(read.select("doc_id").where("doc_id IS NOT NULL")), "next-ids")
    facts = read.withColumn("keys", digests(F.col("text"))).withColumn("cells", sketch(F.col("keys")))
    whole = F.struct("text", "keys", "cells")
    firsts = facts.join(after.select("next_id").distinct(), F.col("doc_id") == F.col("next_id"), "left_semi")
    firsts = firsts.groupBy("doc_id").agg(F.min_by(whole, F.xxhash64("text")).alias("later")).withColumnRenamed("doc_id", "next_id")
    after, _ = written(after.join(firsts, "next_id").select("bucket", "later"), "next-texts")
    bucket = F.coalesce(F.shiftright("doc_id", BUCKET_BITS), F.pmod(F.xxhash64("text"), F.lit(1 << 20)) - (1 << 60))
    order = W.partitionBy("bucket").orderBy("doc_id", F.xxhash64("text"))
    rows = facts.withColumn("bucket", bucket).withColumn("next", F.when(F.col("doc_id").isNotNull(), F.lead(whole).over(order)))
    rows = rows.join(after, "bucket", "left").withColumn("next", F.coalesce("next", "later"))
    n = F.length("text")
    quarter = F.when(F.col("next").isNull(), 0).otherwise(F.shiftright(n, 2))
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.coalesce(F.substring(F.col("next.text"), F.lit(1), quarter), F.lit("")))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "keys", "cells", F.col("next.keys").alias("next_keys"), F.col("next.cells").alias("next_cells"), edited.alias("edited"))
    rows = rows.withColumns({"edited_sha256": F.sha2("edited", 256), "edited_keys": digests(F.col("edited"))}).drop("edited").withColumn("edited_cells", sketch(F.col("edited_keys")))
    rows = rows.withColumn("differing", differing(F.col("keys"), F.col("edited_keys"), F.col("cells"), F.col("edited_cells")))
    total = F.size("keys") + F.size("edited_keys")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        as_string(F.col("keys"), F.col("cells")).alias("fingerprint"),
        as_string(F.col("edited_keys"), F.col("edited_cells")).alias("edited_fingerprint"),
        F.when(total == 0, F.lit(1.0)).otherwise((total - F.size("differing")) / total).alias("near_edited"),
        F.when(F.col("next_keys").isNull(), F.lit(0.0)).otherwise(likeness(F.col("keys"), F.col("next_keys"), F.col("cells"), F.col("next_cells"))).alias("near_next"),
        "differing",
    )


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents."""
    return fingerprints(documents(spark, sf_dir)).drop("differing")


QUERIES = {"op10_fingerprint": op10_fingerprint}
ORACLE_SQL: dict[str, str] = {}
