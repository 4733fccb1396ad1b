"""Logical paths in Spark schemas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError


def type_at(schema: T.StructType, path: str) -> T.DataType | None:
    """The type at a dotted path; null if there is none.  Arrays aren't entered."""
    at: T.DataType = schema
    for part in path.split("."):
        if not isinstance(at, T.StructType) or part not in at.fieldNames():
            return None
        at = at[part].dataType
    return at


def column(path: str, schema: T.StructType | None = None) -> Column:
    """The column at a path; with a schema, unknown paths are an error."""
    if schema is not None and type_at(schema, path) is None:
        raise QueryError("INVALID_QUERY", "unknown field", path)
    return F.col(".".join(f"`{p}`" for p in path.split(".")))
