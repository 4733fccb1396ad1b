"""Readers: Parquet folders, catalog tables, in-memory rows, providers, dictionaries and JDBC."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from ..model import Model


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _file(spark: SparkSession, path: str) -> tuple[Any, Any]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file(spark, path)
    return fs.exists(at)


def _lists(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    fs, at = _file(spark, f"{root}/_tables")
    return sorted((int(s.getPath().getName()), s.getPath().toString()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()) if fs.exists(at) else []


def current(spark: SparkSession, root: str) -> dict[str, str]:
    """The folder of each table as of the last commit under a root."""
    found = _lists(spark, root)
    return json.loads(spark.read.text(found[-1][1], wholetext=True).first()[0]) if found else {}


def publish(spark: SparkSession, root: str, tables: dict[str, str]) -> None:
    """Makes a list of tables the current one: it is written aside, then moved to the next number, which only one writer can take."""
    fs, aside = _file(spark, f"{root}/_tables/_{uuid.uuid4().hex}")
    out = fs.create(aside)
    try:
        out.write(bytearray(json.dumps(tables).encode()))
    finally:
        out.close()
    found = _lists(spark, root)
    _, to = _file(spark, f"{root}/_tables/{(found[-1][0] if found else 0) + 1}")
    if fs.exists(to) or not fs.rename(aside, to):
        raise QueryError("CONFLICT", "another commit came first", root)


def rows(spark: SparkSession, model: Model, values: list[dict]) -> DataFrame:
    """A snapshot of rows held in memory."""
    names = [f.name for f in model.fields if not f.ignore]
    return spark.createDataFrame([tuple(v.get(n) for n in names) for v in values], model.schema())


def provided(provider: Callable[[], Any], spark: SparkSession, model: Model) -> DataFrame:
    """What a provider returns now: a table, or rows for one.  Called once for each logical read."""
    found = provider()
    return found if isinstance(found, DataFrame) else rows(spark, model, list(found))


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of another database; filters and column choice are pushed down by Spark."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def dictionary_search(df: DataFrame, fields: list[str], text: str) -> DataFrame:
    """Value help: rows in which a searchable field contains the text, in any case."""
    if not fields:
        raise QueryError("INVALID_QUERY", "no searchable field")
    found = F.lit(False)
    for f in fields:
        found = found | F.coalesce(F.contains(F.lower(F.col(f"`{f}`").cast("string")), F.lit(text.lower())), F.lit(False))
    return df.where(found)


def logical(df: DataFrame, model: Model) -> DataFrame:
    """Stored columns under their logical names; flattened objects become structs again.

    An optional object all of whose leaves are null is null; a required one is an
    object of nulls.
    """
    if not model.flattened:
        names = {f.column: f.name for f in model.fields if f.column and f.column != f.name and f.column in df.columns}
        return df.withColumnsRenamed(names) if names else df
    held = set(df.columns)

    def build(f, path: str):
        name = f"{path}{f.name}"
        if f.fields and not f.array and not f.json:
            inner = [(x, build(x, f"{name}__")) for x in f.fields if not x.ignore]
            inner = [(x, c) for x, c in inner if c is not None]
            if not inner:
                return None
            value = F.struct(*[c.alias(x.name) for x, c in inner])
            if f.optional:
                empty = F.lit(True)
                for _, c in inner:
                    empty = empty & c.isNull()
                return F.when(~empty, value)
            return value
        stored = f"{path}{f.column or f.name}"
        if stored not in held:
            return None
        own = F.col(f"`{stored}`")
        return F.from_json(own, f.spark_type()) if f.array and dict(df.dtypes)[stored] == "string" else own

    made = [(f, build(f, "")) for f in model.fields if not f.ignore]
    return df.select(*[c.alias(f.name) for f, c in made if c is not None])


def physical(df: DataFrame, model: Model) -> DataFrame:
    """The reverse of :func:`logical`, for writing; arrays become JSON text in flattened storage."""
    if not model.flattened:
        return df.withColumnsRenamed({f.name: f.column for f in model.fields if f.column and f.name in df.columns})
    out = []
    for path, stored, f in model.leaves():
        if path.split(".")[0] in df.columns:
            own = F.col(".".join(f"`{p}`" for p in path.split(".")))
            out.append((F.to_json(own) if f.array else own).alias(stored))
    return df.select(*out)
