"""Sort specifications and paging."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from ..errors import QueryError
from .paths import column, type_at


def parse_sort(spec: Any) -> list[tuple[str, int]]:
    """``{f: ±1}``, ``"-f"``, ``"f:desc"``, comma-separated text, or lists of these."""
    if not spec:
        return []
    if isinstance(spec, dict):
        return [(k, -1 if v in (-1, "desc") else 1) for k, v in spec.items()]
    if isinstance(spec, str):
        out = []
        for part in filter(None, (p.strip() for p in spec.split(","))):
            name, _, how = part.partition(":")
            down = name.startswith("-") or how.lower() == "desc"
            out.append((name.lstrip("-+"), -1 if down else 1))
        return out
    return [x for part in spec for x in parse_sort(part)]


def sort_columns(spec: Any, schema: T.StructType, tie_break: tuple[str, ...] = ()) -> list[Column]:
    """Sort columns; nulls are low.  An object is silently no sort key; ``tie_break`` makes the order total."""
    out = []
    wanted = parse_sort(spec)
    for name, how in wanted:
        kind = type_at(schema, name)
        if kind is None:
            raise QueryError("INVALID_QUERY", "unknown field", name)
        if not isinstance(kind, T.StructType):
            c = column(name)
            out.append(c.asc_nulls_first() if how > 0 else c.desc_nulls_last())
    held = {n for n, _ in wanted}
    return out + [column(k).asc_nulls_first() for k in tie_break if out and k not in held and type_at(schema, k) is not None]


def page(df: DataFrame, skip: int | None, limit: int | None) -> DataFrame:
    if skip:
        df = df.offset(int(skip))
    return df if limit is None else df.limit(int(limit))
