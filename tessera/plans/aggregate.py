"""Grouped queries: groupBy, aggregates, having, sort, paging and group counts."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..model import NUMERIC, Model
from .filters import Filters, apply_filter
from .paths import column
from .sorting import page, sort_columns

FUNCTIONS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def alias_of(item: dict) -> str:
    return item.get("$as") or (f"{item['$fn']}_{item['$field']}" if item["$field"] != "*" else f"{item['$fn']}_*")


def agg_column(item: dict) -> Column:
    fn, name = item["$fn"], item["$field"]
    if fn == "count":
        made = F.count(F.lit(1)) if name == "*" else F.count(column(name))
    elif fn in FUNCTIONS and name != "*":
        made = FUNCTIONS[fn](column(name))
    else:
        raise QueryError("INVALID_QUERY", "unknown aggregate", f"{fn}({name})")
    return made.alias(alias_of(item))


def check(query: dict, model: Model | None) -> tuple[list[str], list[dict]]:
    """The plain fields and the aggregates of a grouped query, validated."""
    controls = query.get("controls") or {}
    groups = list(controls.get("$groupBy") or [])
    select = controls.get("$select") or []
    plain = [s for s in select if isinstance(s, str)]
    items = [s for s in select if isinstance(s, dict)]
    if controls.get("$with"):
        raise QueryError("INVALID_QUERY", "$with can't be combined with $groupBy", "$with")
    for name in plain:
        if name not in groups:
            raise QueryError("INVALID_QUERY", "a plain field must be grouped", name)
    if model is not None:
        for name in [*groups, *[i["$field"] for i in items if i["$field"] != "*"]]:
            f = model.find(name)
            if f is None:
                raise QueryError("INVALID_QUERY", "unknown field", name)
            if f.write_only:
                raise QueryError("INVALID_QUERY", "the field is never read", name)
            if f.encrypted:
                raise QueryError("ENC_FIELD_AGG", "an encrypted field can't be aggregated", name)
        if model.dimensions or model.measures:
            for name in groups:
                if name not in model.dimensions:
                    raise QueryError("INVALID_QUERY", "not a dimension", name)
            for item in items:
                if item["$field"] != "*" and item["$field"] not in model.measures:
                    raise QueryError("INVALID_QUERY", "not a measure", item["$field"])
        for item in items:
            f = model.find(item["$field"]) if item["$field"] != "*" else None
            if f is None:
                continue
            if item["$fn"] in ("sum", "avg") and f.type not in NUMERIC:
                raise QueryError("INVALID_QUERY", "sum and avg take numbers", item["$field"])
            for ref in (f.currency_ref, f.unit_ref):
                if ref and item["$fn"] != "count" and ref not in groups:
                    raise QueryError("INVALID_QUERY", f"needs {ref} in $groupBy", item["$field"])
    return groups, items


def aggregate(df: DataFrame, query: dict, model: Model | None = None, null_model: str = "sql") -> DataFrame:
    """Runs a grouped query.  Filters come before grouping, ``$having`` after, and group counts after that."""
    controls = query.get("controls") or {}
    groups, items = check(query, model)
    df = apply_filter(df, query.get("filter"), null_model)
    keys = [column(g, df.schema).alias(g) for g in groups]
    made = [agg_column(i) for i in items]
    if groups:
        df = df.groupBy(*keys).agg(*made) if made else df.select(*keys).distinct()
    elif made:
        df = df.agg(*made)
    elif controls.get("$count"):
        return df.agg(F.count(F.lit(1)).alias("count"))
    if controls.get("$having"):
        df = df.where(Filters(df.schema, null_model).compile(controls["$having"]))
    if controls.get("$count"):
        return df.agg(F.count(F.lit(1)).alias("count"))
    order = sort_columns(controls.get("$sort"), df.schema)
    if order:
        df = df.orderBy(*order)
    df = page(df, controls.get("$skip"), controls.get("$limit"))
    chosen = [s for s in controls.get("$select") or [] if isinstance(s, str)]
    return df.select(*[F.col(f"`{c}`") for c in (chosen or groups) + [alias_of(i) for i in items]])
