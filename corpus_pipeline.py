"""The corpus pipeline: five operators, one after the other, over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as
Parquet and reread as the next stage's ``docs``.  All but the last return the
columns of documents, and no others: extra columns are left behind, whatever their
names.

Defined results: an empty table stays empty in every stage; a null text, an empty one
and one without letters have no language and go in the first stage; rows without an
id are kept where their text is, and are no one's copies; of rows that are repeated
(id and text), one stays; rows that share an id but not the text are documents of
their own; very long texts are treated as any other; null language and source are
kept as they are, null being a source to mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import op1_bpe, op2_jaccard, op4_langid, op7_substrings, op8_mixing
from tessera.llm.shared import discard, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letters) go; the rest carry the predicted one, learnt from those not held out."""
    learnt = op4_langid.learn(docs.where(~op4_langid.held_out()))
    found = op4_langid.identify(docs.select(*COLUMNS), learnt)
    return found.where(F.col("lang_pred") != "und").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays; of rows that are repeated, one; rows without id."""
    kept = op2_jaccard.classes(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    rows = docs.select(*COLUMNS)
    # Joined by a plain key, rows lie as dropping the repeated ones needs them, so that texts are shuffled once.
    named = rows.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(rows.where("doc_id IS NULL").dropDuplicates(["text"])).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows go, all else of a text stays as it is; a text with nothing left goes."""
    # A text from which nothing goes is kept as it was, so that it isn't carried beside itself; only null would come back empty.
    rows = docs.select("doc_id", "text", "lang", "source", F.col("text").isNull().alias("missing"))
    cut = op7_substrings.remove_repeats(rows, carry=("lang", "source", "missing"))
    text = F.when(~F.col("missing"), F.col("kept"))
    kept = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each draw, of the words drawn, written shard by shard in the order of the local shuffle."""
    drawn = op8_mixing.mix(docs, carry=("text", "lang", "n_chars"))
    rows = drawn.select("doc_id", "text", "lang", "source", "n_chars", "size", F.explode("draws").alias("draw"))
    rows = rows.select("*", F.col("draw.shard").alias("shard"), F.col("draw.place").alias("place"))
    # Shards are of equal size and numbered from 0: dealt by number they fill tasks evenly, where hashes of few shards collide.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard", "place")
    part = F.col("draw.words") < F.col("size")
    text = F.when(part, op8_mixing.first_words(F.col("text"), F.col("draw.words"))).otherwise(F.col("text"))
    return rows.withColumn("text", text).withColumn("n_chars", F.when(part, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each drawn text, with the digests of ids and decoded text; rows as they come."""
    import public_tokenizers

    return op1_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_text=False)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL can't express language identification or byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, *filter(None, [last]))
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {}
