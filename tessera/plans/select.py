"""Projections: include and exclude lists over nested paths."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from .paths import column, type_at


def split_select(select: Any) -> tuple[list[str], bool]:
    """The paths of a ``$select`` and whether they are included.  The first entry of a map decides."""
    if isinstance(select, dict):
        if not select:
            return [], False
        include = bool(next(iter(select.values())))
        return [k for k, v in select.items() if bool(v) == include], include
    names = [s for s in select or [] if isinstance(s, str)]
    if names and names[0].startswith("-"):
        return [n.removeprefix("-") for n in names], False
    return names, True


def without_children(paths: list[str]) -> list[str]:
    """Paths without duplicates and without those whose parent is there too."""
    held = set(paths)
    return [p for i, p in enumerate(paths) if p not in paths[:i] and not any(".".join(p.split(".")[:k]) in held for k in range(1, p.count(".") + 1))]


def _rebuilt(paths: list[list[str]], prefix: list[str], schema: T.StructType) -> list[Column]:
    """Columns of the given paths, nested ones gathered in structs; a null parent stays null."""
    out, done = [], set()
    for path in paths:
        head = path[0]
        if head in done:
            continue
        done.add(head)
        full = ".".join([*prefix, head])
        inner = [p[1:] for p in paths if p[0] == head]
        if any(not p for p in inner):
            out.append(column(full).alias(head))
        else:
            parent = column(full)
            out.append(F.when(parent.isNotNull(), F.struct(*_rebuilt(inner, [*prefix, head], schema))).alias(head))
    return out


def project(df: DataFrame, select: Any, *, keep: tuple[str, ...] = (), hidden: tuple[str, ...] = ()) -> DataFrame:
    """Applies a ``$select``.

    ``keep`` are columns that an inclusion always has (keys, widened references);
    ``hidden`` never leave.  Unknown paths are an error.
    """
    paths, include = split_select(select)
    for p in paths:
        if type_at(df.schema, p) is None:
            raise QueryError("INVALID_QUERY", "unknown field", p)
    if paths and include:
        paths = without_children([p for p in [*paths, *[k for k in keep if k not in paths]] if p.split(".")[0] not in hidden])
        return df.select(*_rebuilt([p.split(".") for p in paths], [], df.schema))
    for p in paths:
        if "." not in p:
            if p not in keep:
                df = df.drop(p)
        else:
            top, rest = p.split(".", 1)
            df = df.withColumn(top, column(top).dropFields(rest))
    return df.drop(*hidden) if hidden else df
