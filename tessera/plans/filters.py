"""Filters: from the JSON form to one boolean ``Column``.

Two null models exist.  ``sql`` is three-valued: a comparison with null is
unknown, so negations drop null rows.  ``document`` is two-valued: null equals
null, and a negation keeps what the plain form doesn't match.
"""

from __future__ import annotations

import datetime as dt
import functools
import operator
import re
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions.geo import check_point, haversine
from .paths import column, type_at

#: More values than this in one ``$in`` become a join.
LONG_LIST = 1000
COLLATIONS = {"nocase": "UTF8_LCASE", "unicode": "UNICODE_CI_AI", "binary": None, None: None}
_LITERAL = re.compile(r"\A/(.*)/([a-z]*)\Z", re.S)


def regex_source(value: Any) -> str:
    """A Java pattern from ``/pattern/flags``, a raw pattern or a compiled one."""
    if isinstance(value, re.Pattern):
        flags = "".join(c for c, f in (("i", re.I), ("m", re.M), ("s", re.S)) if value.flags & f)
        pattern = value.pattern
    elif isinstance(value, str):
        found = _LITERAL.match(value)
        pattern, flags = found.groups() if found else (value, "")
    else:
        raise QueryError("INVALID_QUERY", "a pattern must be text", repr(value))
    wanted = "".join(c for c in "ims" if c in flags)
    return f"(?{wanted}){pattern}" if wanted else pattern


class Filters:
    """Compiler of filters over one schema."""

    def __init__(self, schema: T.StructType, null_model: str = "sql", collations: dict[str, str] | None = None):
        self.schema, self.document, self.collations = schema, null_model == "document", collations or {}

    def compile(self, expr: Any) -> Column:
        if expr is None or expr == {}:
            return F.lit(True)
        if not isinstance(expr, dict):
            raise QueryError("INVALID_QUERY", "a filter is an object", repr(expr))
        parts = [self._entry(k, v) for k, v in expr.items()]
        return functools.reduce(operator.and_, parts)

    def _entry(self, key: str, value: Any) -> Column:
        if key == "$and":
            return functools.reduce(operator.and_, [self.compile(x) for x in value], F.lit(True))
        if key == "$or":
            return functools.reduce(operator.or_, [self.compile(x) for x in value], F.lit(False))
        if key == "$not":
            inner = self.compile(value)
            return ~F.coalesce(inner, F.lit(False)) if self.document else ~inner
        if key.startswith("$"):
            raise QueryError("INVALID_QUERY", "unknown operator", key)
        if isinstance(value, dict) and any(k.startswith("$") for k in value):
            return functools.reduce(operator.and_, [self._leaf(key, op, x) for op, x in value.items()])
        if isinstance(value, re.Pattern):
            return self._leaf(key, "$regex", value)
        return self._leaf(key, "$eq", value)

    def _literal(self, path: str, value: Any) -> Column:
        kind = type_at(self.schema, path)
        if isinstance(value, (dict, list)):
            raise QueryError("FILTER_TYPE_MISMATCH", "not a scalar", path)
        literal = F.lit(value)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                if isinstance(kind, T.TimestampType):
                    return F.timestamp_millis(F.lit(int(value)))
                return F.lit(str(dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=value))).cast(kind)
            return F.lit(str(value)).cast(kind) if isinstance(value, (str, dt.date)) else literal
        if isinstance(kind, T.DecimalType) and isinstance(value, (str, float, Decimal)):
            return F.lit(str(value)).try_cast(kind)
        if isinstance(kind, T.IntegralType) and isinstance(value, str) and re.fullmatch(r"\s*[+-]?\d{1,38}\s*", value):
            return F.lit(int(value)) if abs(int(value)) < 1 << 63 else literal.cast("decimal(38,0)")
        if isinstance(kind, T.NumericType) and isinstance(value, str):
            return literal.try_cast("double")
        if isinstance(kind, T.StringType) and isinstance(value, (int, float)) and not isinstance(value, bool):
            return F.lit(str(value))
        return literal

    def _pair(self, path: str, value: Any) -> tuple[Column, Column]:
        own, other = column(path, self.schema), self._literal(path, value)
        collation = COLLATIONS[self.collations.get(path)]
        return (F.collate(own, collation), F.collate(other, collation)) if collation and isinstance(value, str) else (own, other)

    def _leaf(self, path: str, op: str, value: Any) -> Column:
        own = column(path, self.schema)
        two_valued = (lambda c: F.coalesce(c, F.lit(False))) if self.document else (lambda c: c)
        if op in ("$eq", "$ne"):
            if value is None:
                return own.isNull() if op == "$eq" else own.isNotNull()
            left, right = self._pair(path, value)
            if op == "$eq":
                return two_valued(left == right)
            return ~left.eqNullSafe(right) if self.document else left != right
        if op in ("$gt", "$gte", "$lt", "$lte"):
            left, right = self._pair(path, value)
            return two_valued({"$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}[op](left, right))
        if op in ("$in", "$nin"):
            known = [x for x in value if x is not None]
            null = self.document and len(known) < len(value)
            pairs = [self._pair(path, x) for x in known]
            found = pairs[0][0].isin([p[1] for p in pairs]) if pairs else F.lit(False)
            if self.document:
                found = F.coalesce(found, F.lit(False)) | (own.isNull() if null else F.lit(False))
            if op == "$in":
                return found
            return ~found if pairs or null else F.lit(True)
        if op == "$exists":
            return own.isNotNull() if value else own.isNull()
        if op == "$regex":
            return two_valued(own.cast("string").rlike(regex_source(value)))
        if op == "$geoWithin":
            point = check_point(value["center"], path)
            return two_valued(haversine(own, point) <= float(value["radius"]))
        raise QueryError("INVALID_QUERY", "unknown operator", f"{path}.{op}")


def apply_filter(df: DataFrame, expr: Any, null_model: str = "sql", collations: dict[str, str] | None = None) -> DataFrame:
    """Filters a table; a very long ``$in`` at the top becomes a semi-join, which Spark broadcasts only if it is small."""
    if isinstance(expr, dict):
        for key, value in expr.items():
            if isinstance(value, dict) and list(value) == ["$in"] and len(value["$in"]) > LONG_LIST and not (collations or {}).get(key):
                kind = type_at(df.schema, key)
                if kind is None:
                    raise QueryError("INVALID_QUERY", "unknown field", key)
                values = df.sparkSession.createDataFrame([(x,) for x in set(value["$in"]) if x is not None], T.StructType([T.StructField("__value", kind)]))
                rest = {k: v for k, v in expr.items() if k != key}
                return apply_filter(df, rest, null_model, collations).join(values, column(key) == F.col("__value"), "left_semi")
    return df if not expr else df.where(Filters(df.schema, null_model, collations).compile(expr))
