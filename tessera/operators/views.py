"""Managed views: entry table, joins, filter, aggregates and having as one plan."""

from __future__ import annotations

import functools
import operator
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..model import View
from ..plans.aggregate import FUNCTIONS
from ..plans.filters import Filters, regex_source
from ..plans.urlquery import parse_expression

if TYPE_CHECKING:
    from ..sources.space import Space

_COMPARE = {"$eq": operator.eq, "$ne": operator.ne, "$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}


class ViewConditions:
    """Conditions over ``Table.field`` of the tables in scope; a right side may be a field too."""

    def __init__(self, scope: dict[str, DataFrame]):
        self.scope = scope

    def field(self, ref: str) -> Column | None:
        table, dot, path = ref.partition(".")
        if not dot or table not in self.scope:
            return None
        return self.scope[table][".".join(f"`{p}`" for p in path.split("."))] if "." in path else self.scope[table][f"`{path}`"]

    def compile(self, expr: Any) -> Column:
        if isinstance(expr, str):
            expr = parse_expression(expr)
        if not expr:
            return F.lit(True)
        return functools.reduce(operator.and_, [self._entry(k, v) for k, v in expr.items()])

    def _entry(self, key: str, value: Any) -> Column:
        if key == "$and":
            return functools.reduce(operator.and_, [self.compile(x) for x in value], F.lit(True))
        if key == "$or":
            return functools.reduce(operator.or_, [self.compile(x) for x in value], F.lit(False))
        if key == "$not":
            return ~self.compile(value)
        left = self.field(key)
        if left is None:
            raise QueryError("INVALID_QUERY", "not a field in scope", key)
        conditions = value if isinstance(value, dict) and any(k.startswith("$") for k in value) else {"$eq": value}
        return functools.reduce(operator.and_, [self._leaf(left, op, x) for op, x in conditions.items()])

    def _leaf(self, left: Column, op: str, value: Any) -> Column:
        if op == "$exists":
            return left.isNotNull() if value else left.isNull()
        if op == "$regex":
            return left.cast("string").rlike(regex_source(value))
        if op in ("$in", "$nin"):
            found = left.isin(list(value)) if value else F.lit(False)
            return found if op == "$in" else ~found
        if op not in _COMPARE:
            raise QueryError("INVALID_QUERY", "unknown operator", op)
        if value is None:
            return left.isNull() if op == "$eq" else left.isNotNull()
        right = self.field(value) if isinstance(value, str) else None
        return _COMPARE[op](left, F.lit(value) if right is None else right)


def view_frame(view: View, space: "Space") -> DataFrame:
    """The plan of a view.  Plain columns group if any column is an aggregate."""
    if view.entry is None:
        return external(view, space)
    scope = {view.entry: space.table(view.entry).frame()}
    rows = scope[view.entry]
    for j in view.joins:
        scope[j.target] = space.table(j.target).frame()
        if j.target == view.entry:
            raise QueryError("INVALID_QUERY", "a view can't join its entry", j.target)
        rows = rows.join(scope[j.target], ViewConditions({k: scope[k] for k in scope}).compile(j.on), j.how)
    conditions = ViewConditions(scope)
    if view.filter:
        rows = rows.where(conditions.compile(view.filter))
    plain = [c for c in view.columns if c.agg is None]
    aggs = [c for c in view.columns if c.agg is not None]

    def source(c) -> Column:
        found = conditions.field(c.source)
        if found is None:
            raise QueryError("INVALID_QUERY", "not a field in scope", c.source)
        return found

    if not aggs:
        out = rows.select(*[source(c).alias(c.name) for c in plain])
    else:
        made = []
        for c in aggs:
            if c.agg == "count":
                made.append((F.count(F.lit(1)) if c.source == "*" else F.count(source(c))).alias(c.name))
            elif c.agg in FUNCTIONS:
                made.append(FUNCTIONS[c.agg](source(c)).alias(c.name))
            else:
                raise QueryError("INVALID_QUERY", "unknown aggregate", c.agg)
        out = (rows.groupBy(*[source(c).alias(c.name) for c in plain]) if plain else rows).agg(*made)
    if view.having:
        having = parse_expression(view.having) if isinstance(view.having, str) else view.having
        out = out.where(Filters(out.schema).compile(having))
    return out.select(*[c.name for c in view.columns])


def external(view: View, space: "Space") -> DataFrame:
    """A table that exists already; its declared columns must be there."""
    if not space.spark.catalog.tableExists(view.name):
        raise QueryError("NOT_FOUND", "the external view doesn't exist", view.name)
    rows = space.spark.table(view.name)
    for f in view.schema or []:
        if f.name not in rows.columns:
            raise QueryError("NOT_FOUND", "the external view lacks a column", f.name)
    return rows


def materialize(view: View, space: "Space", path: str) -> DataFrame:
    """Writes a view's rows and reads them from then on; call again to refresh."""
    rows = view_frame(view, space)
    rows.write.mode("overwrite").parquet(path)
    return space.spark.read.schema(rows.schema).parquet(path)
