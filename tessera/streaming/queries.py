"""Filters, projections and windowed aggregates over streams.

The compilers only build columns, so what doesn't need a total order works on a
stream as on a table.  Grouped stream queries need an event time and a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from ..plans.aggregate import agg_column, check
from ..plans.filters import Filters, apply_filter
from ..plans.paths import column
from ..plans.select import project


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of a folder as they arrive, with the schema of those that are there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def find(stream: DataFrame, query: dict, null_model: str = "sql") -> DataFrame:
    controls = query.get("controls") or {}
    for name in ("$sort", "$skip", "$limit", "$with"):
        if controls.get(name):
            raise QueryError("INVALID_QUERY", "not on a stream", name)
    return project(apply_filter(stream, query.get("filter"), null_model), controls.get("$select"))


def aggregate(stream: DataFrame, query: dict, *, time: str, window: str, delay: str = "10 minutes", slide: str | None = None, null_model: str = "sql") -> DataFrame:
    """Groups by an event-time window as well as ``$groupBy``; late rows count until ``delay``."""
    groups, items = check(query, None)
    rows = apply_filter(stream.withWatermark(time, delay), query.get("filter"), null_model)
    span = F.window(column(time), window, slide) if slide else F.window(column(time), window)
    made = [agg_column(i) for i in items] or [F.count(F.lit(1)).alias("count")]
    out = rows.groupBy(span, *[column(g).alias(g) for g in groups]).agg(*made)
    having = (query.get("controls") or {}).get("$having")
    if having:
        out = out.where(Filters(out.schema, null_model).compile(having))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])
