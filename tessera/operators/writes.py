"""Writes as functions from a table to its next state.

Nothing is changed in place: each function returns the rows a table has after
the write, lazily, and counts are plans of their own.  The caller commits by
writing the result (``Table.commit``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.geo import valid_point
from ..model import Model
from ..plans.filters import Filters
from .patch import patch_columns


def with_defaults(new: DataFrame, model: Model, existing: DataFrame | None = None) -> DataFrame:
    """Adds what inserted rows leave out: literals, uuid, now, increments, version 0, nulls.

    Increments go on from the highest value in hand.  They are dealt by a hash
    order of the new rows; only the new rows pass the one window.
    """
    for f in model.fields:
        if f.ignore:
            new = new.drop(f.name)
            continue
        missing = f.name not in new.columns
        own = F.lit(None).cast(f.spark_type()) if missing else F.col(f"`{f.name}`").cast(f.spark_type())
        if f.version:
            value: Column = F.lit(0)
        elif f.default_fn == "uuid":
            value = F.expr("uuid()")
        elif f.default_fn == "now":
            value = F.current_timestamp()
        elif f.default_fn == "increment":
            top = existing.agg(F.max(f.name)).first()[0] if existing is not None else None
            base = f.start - 1 if top is None else max(int(top), f.start - 1)
            rest = [c for c in new.columns if c != f.name]
            value = F.lit(base) + F.row_number().over(W.partitionBy(F.lit(0)).orderBy(own.isNotNull(), *[F.col(f"`{c}`").cast("string") for c in rest]))
        elif f.default is not None:
            value = F.lit(f.default)
        else:
            value = F.lit(None)
        new = new.withColumn(f.name, F.coalesce(own, value.cast(f.spark_type())))
    return new.select(*[f.name for f in model.fields if not f.ignore])


def violations(rows: DataFrame, model: Model, only: set[str] | None = None) -> DataFrame:
    """Rows that break the model, with ``problem``: missing values and points out of bounds; ``only`` in some fields."""
    problems = []
    for f in model.fields:
        if f.ignore or only is not None and f.name not in only:
            continue
        c = F.col(f"`{f.name}`")
        if not f.optional:
            problems.append(F.when(c.isNull(), F.lit(f"{f.name} is required")))
        if f.type == "geopoint":
            problems.append(F.when(c.isNotNull() & ~valid_point(c), F.lit(f"{f.name} is not a point")))
        if f.type == "vector" and f.dims:
            problems.append(F.when(F.size(c) != f.dims, F.lit(f"{f.name} needs {f.dims} components")))
        if f.type == "currency":
            problems.append(F.when(~c.rlike("^[A-Z0-9]{2,10}$"), F.lit(f"{f.name} is not a currency")))
    return rows.withColumn("problem", F.coalesce(*problems) if problems else F.lit(None).cast("string")).where("problem IS NOT NULL")


def duplicates(rows: DataFrame, model: Model, new: DataFrame | None = None, changed: set[str] | None = None) -> DataFrame | None:
    """Keys and unique tuples that occur more than once (constraint, values, n); tuples with a null are exempt.

    With ``new``, only those that the new rows have, so that the rest of the table is
    not grouped; with ``changed``, only tuples with such a field.  None if none is left.
    """
    found = []
    for fields in model.identifications():
        if changed is not None and not changed & set(fields):
            continue
        known = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in fields])
        own = rows.where(known)
        if new is not None:
            own = own.join(new.select(*[F.col(f"`{k}`") for k in fields]), list(fields), "left_semi")
        many = own.groupBy(*[F.col(f"`{k}`") for k in fields]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found.append(many.select(F.lit(",".join(fields)).alias("constraint"), F.to_json(F.struct(*[F.col(f"`{k}`") for k in fields])).alias("values"), "n"))
    return reduce(lambda a, b: a.unionByName(b), found) if found else None


def insert(table: DataFrame, new: DataFrame, model: Model) -> DataFrame:
    return table.unionByName(with_defaults(new, model, table).select(*table.columns))


def _matched(table: DataFrame, changes: DataFrame, keys: tuple[str, ...], cas: str | None, model: Model) -> tuple[DataFrame, Column]:
    other = changes.select(*[F.col(f"`{c}`").alias(f"__new_{c}") for c in changes.columns], F.lit(True).alias("__hit"))
    on = reduce(lambda a, b: a & b, [table[f"`{k}`"] == other[f"__new_{k}"] for k in keys])
    joined = table.join(other, on, "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    if cas is not None:
        hit = hit & F.col(model.version).eqNullSafe(F.col(f"__new_{cas}"))
    return joined, hit


def replace_rows(table: DataFrame, new: DataFrame, model: Model, *, keys: tuple[str, ...] | None = None, cas: str | None = None) -> DataFrame:
    """Whole-row replacement by key: what a new row leaves out becomes its default or null.  Rows without a partner stay."""
    keys = keys or model.pk
    given = [c for c in new.columns]
    joined, hit = _matched(table, new, keys, cas, model)
    out = []
    for c in table.columns:
        f, own = model.find(c), F.col(f"`{c}`")
        if c in keys:
            out.append(own.alias(c))
        elif f is not None and f.version:
            out.append(F.when(hit, F.coalesce(own, F.lit(0)) + 1).otherwise(own).cast(table.schema[c].dataType).alias(c))
        else:
            value = F.col(f"__new_{c}") if c in given else F.lit(f.default if f is not None else None)
            out.append(F.when(hit, value.cast(table.schema[c].dataType)).otherwise(own).alias(c))
    return joined.select(*out)


def update_rows(table: DataFrame, patches: DataFrame, model: Model, *, keys: tuple[str, ...] | None = None, cas: str | None = None, nulls: tuple[str, ...] = ()) -> DataFrame:
    """Partial rows by key: columns that ``patches`` has are set where not null, those in ``nulls`` always; each row hit gets its next version."""
    keys = keys or model.pk
    if model.version and model.version in patches.columns and model.version != cas:
        raise QueryError("VERSION_COLUMN_WRITE", "a version is never written", model.version)
    joined, hit = _matched(table, patches, keys, cas, model)
    out = []
    for c in table.columns:
        own = F.col(f"`{c}`")
        if model.version == c:
            own = F.when(hit, F.coalesce(own, F.lit(0)) + 1).otherwise(own).cast(table.schema[c].dataType)
        elif c in patches.columns and c not in keys:
            new = F.col(f"__new_{c}").cast(table.schema[c].dataType)
            own = F.when(hit, new if c in nulls else F.coalesce(new, own)).otherwise(own)
        out.append(own.alias(c))
    return joined.select(*out)


def update_many(table: DataFrame, filter: Any, changes: dict, model: Model, null_model: str = "sql", collations: dict[str, str] | None = None) -> DataFrame:
    """Patches every row that a filter matches; ``$cas`` is for single rows only."""
    if "$cas" in changes:
        raise QueryError("INVALID_QUERY", "$cas is for one row", "$cas")
    hit = F.coalesce(Filters(table.schema, null_model, collations).compile(filter), F.lit(False))
    new = patch_columns(table, changes, model, null_model)
    return table.select(*[(F.when(hit, new[c]).otherwise(F.col(f"`{c}`")) if c in new else F.col(f"`{c}`")).alias(c) for c in table.columns])


def replace_many(table: DataFrame, filter: Any, row: dict, model: Model, null_model: str = "sql") -> DataFrame:
    """Sets the same values on every row that a filter matches."""
    return update_many(table, filter, row, model, null_model)


def identified(payload: dict, model: Model) -> tuple[dict, dict]:
    """The filter for the row that a payload identifies, with ``$cas`` at that version only, and the changes."""
    payload = dict(payload)
    version = payload.pop("$cas", None)
    keys = next((k for k in model.identifications() if all(payload.get(x) is not None for x in k)), None)
    if keys is None:
        raise QueryError("NOT_FOUND", "the payload identifies no row", model.name)
    filter = {k: payload.pop(k) for k in keys}
    if version is not None:
        if not model.version:
            raise QueryError("INVALID_QUERY", "the model has no version", "$cas")
        filter[model.version] = version
    return filter, payload


def update_one(table: DataFrame, payload: dict, model: Model, null_model: str = "sql") -> DataFrame:
    """Patches the row that a payload identifies; with ``$cas`` only at that version."""
    filter, changes = identified(payload, model)
    return update_many(table, filter, changes, model, null_model) if changes else table


def delete_many(table: DataFrame, filter: Any, null_model: str = "sql", collations: dict[str, str] | None = None) -> DataFrame:
    return table.where(~F.coalesce(Filters(table.schema, null_model, collations).compile(filter), F.lit(False)))


def matched_count(table: DataFrame, filter: Any, null_model: str = "sql") -> DataFrame:
    """How many rows a write hits, as a one-row table."""
    return table.where(Filters(table.schema, null_model).compile(filter)).agg(F.count(F.lit(1)).alias("matched"))


def optimistic(read: Callable[[], Any], mutate: Callable[[Any], Any], write: Callable[[Any], bool], attempts: int = 5) -> Any:
    """Reads, changes and writes until the version still holds."""
    for _ in range(attempts):
        current = read()
        if current is None:
            raise QueryError("NOT_FOUND", "no such row")
        changed = mutate(current)
        if write(changed):
            return changed
    raise QueryError("CAS_EXHAUSTED", f"still stale after {attempts} attempts")


def timestamp(ms: int) -> dt.datetime:
    return dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc).replace(tzinfo=None)
