"""Patches: field operations, merged objects and array operations, as column expressions."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..model import NUMERIC, Field, Model

ARRAY_OPS = ("$replace", "$insert", "$upsert", "$update", "$remove")
FIELD_OPS = ("$inc", "$dec", "$mul")


def inc(n=1):
    return {"$inc": n}


def dec(n=1):
    return {"$dec": n}


def mul(n):
    return {"$mul": n}


def cas(version: int):
    return {"$cas": version}


def replace(items):
    return {"$replace": items}


def insert(items):
    return {"$insert": items}


def upsert(items):
    return {"$upsert": items}


def update(items):
    return {"$update": items}


def remove(items):
    return {"$remove": items}


def value_literal(value: Any, kind: T.DataType) -> Column:
    """A Python value as a column of a type; objects and arrays by way of JSON."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.from_json(F.lit(json.dumps(value, default=str)), kind)
    return F.lit(value).cast(kind)


def field_op(own: Column, op: str, n: Any, null_model: str) -> Column:
    base = F.coalesce(own, F.lit(0)) if null_model == "document" else own
    return {"$inc": base + F.lit(n), "$dec": base - F.lit(n), "$mul": base * F.lit(n)}[op]


def _same_keys(keys: tuple[str, ...], a: Column, b: Column) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def _merged(old: Column, new: Column, kind: T.StructType) -> Column:
    """``old`` with the fields that an operand item gives, nulls too; what it leaves out is kept."""
    return F.struct(*[F.when(F.array_contains(new["given"], f.name), new["item"][f.name]).otherwise(old[f.name]).alias(f.name) for f in kind.fields])


def _operand(items: list[dict], kind: T.ArrayType) -> Column:
    """Operand items with the names of the fields that each one gives."""
    given = F.array(*[F.array(*[F.lit(str(k)) for k in x]) for x in items])
    return F.zip_with(value_literal(items, kind), given, lambda item, names: F.struct(item.alias("item"), names.alias("given")))


def _last_by_key(items: list[dict], keys: tuple[str, ...]) -> list[dict]:
    """One item for each key, the last, where the first was."""
    return list({tuple(repr(x[k]) for k in keys): x for x in items}.values())


def _added(own: Column, new: Column) -> Column:
    """``own`` as it is, and what it lacks of ``new``, each value once."""
    return F.concat(own, F.filter(F.array_distinct(new), lambda u: ~F.exists(own, lambda x: x.eqNullSafe(u))))


def array_patch(own: Column, ops: dict, f: Field, kind: T.ArrayType) -> Column:
    """Array operations in fixed order: remove, update, upsert, insert; or a whole replacement.

    With key fields, items are matched by these; without, by value.
    """
    unknown = [k for k in ops if k not in ARRAY_OPS]
    if unknown:
        raise QueryError("INVALID_QUERY", "unknown array operation", f"{f.name}.{unknown[0]}")
    element, keys = kind.elementType, f.keys
    if "$replace" in ops:
        return value_literal(ops["$replace"], kind)
    for op in ("$update", "$remove", "$upsert"):
        for item in ops.get(op) or []:
            if keys and not (isinstance(item, dict) and all(k in item for k in keys)):
                raise QueryError("INVALID_QUERY", f"{op} needs the key fields {keys}", f.name)
    out = F.coalesce(own, F.array().cast(kind))
    if ops.get("$remove"):
        gone = value_literal(ops["$remove"], kind)
        if keys:
            out = F.filter(out, lambda x: ~F.exists(gone, lambda g: _same_keys(keys, x, g)))
        else:
            out = F.filter(out, lambda x: ~F.exists(gone, lambda g: x.eqNullSafe(g)))

    def one(items: Column, x: Column) -> Column:
        return F.try_element_at(F.filter(items, lambda u: _same_keys(keys, x, u["item"])), F.lit(-1))

    if ops.get("$update") and keys:
        given = _operand(ops["$update"], kind)
        out = F.transform(out, lambda x: F.when(one(given, x).isNotNull(), _merged(x, one(given, x), element)).otherwise(x))
    if ops.get("$upsert"):
        if keys:
            items = _last_by_key(ops["$upsert"], keys)
            kept, new, operand = out, value_literal(items, kind), _operand(items, kind)
            changed = lambda x: _merged(x, one(operand, x), element) if f.merge else one(operand, x)["item"]
            out = F.concat(F.transform(kept, lambda x: F.when(one(operand, x).isNotNull(), changed(x)).otherwise(x)), F.filter(new, lambda u: ~F.exists(kept, lambda x: _same_keys(keys, x, u))))
        else:
            out = _added(out, value_literal(ops["$upsert"], kind))
    if ops.get("$insert"):
        new = value_literal(ops["$insert"], kind)
        if not f.unique_items:
            out = F.concat(out, new)
        elif keys:
            kept, new = out, value_literal(_last_by_key(ops["$insert"][::-1], keys)[::-1], kind)
            out = F.concat(kept, F.filter(new, lambda u: ~F.exists(kept, lambda x: _same_keys(keys, x, u))))
        else:
            out = _added(out, new)
    return out


def patched(own: Column, value: Any, f: Field, kind: T.DataType, null_model: str = "sql") -> Column:
    """The new value of a field under a patch."""
    if isinstance(value, dict) and len(value) == 1 and next(iter(value)) in FIELD_OPS:
        op, n = next(iter(value.items()))
        if f.encrypted:
            raise QueryError("ENC_FIELD_PATCH_OP", "an encrypted field takes no operations", f.name)
        if f.type not in NUMERIC or f.json or f.array:
            raise QueryError("INVALID_QUERY", "a field operation needs a number", f.name)
        return field_op(own, op, n, null_model).cast(kind)
    if isinstance(kind, T.ArrayType) and isinstance(value, dict):
        return array_patch(own, value, f, kind)
    if isinstance(kind, T.StructType) and isinstance(value, dict) and f.merge:
        inner = {x.name: x for x in f.fields}
        for name in value:
            if name not in inner:
                raise QueryError("INVALID_QUERY", "unknown field", f"{f.name}.{name}")
        return F.struct(*[(patched(own[s.name], value[s.name], inner[s.name], s.dataType, null_model) if s.name in value else own[s.name]).alias(s.name) for s in kind.fields])
    return value_literal(value, kind)


def patch_columns(df: DataFrame, changes: dict, model: Model, null_model: str = "sql") -> dict[str, Column]:
    """New values of the columns that a patch touches, and the version that every update raises."""
    out = {}
    for name, value in changes.items():
        f = model.find(name)
        if f is None or name not in df.columns:
            raise QueryError("INVALID_QUERY", "unknown field", name)
        if f.version:
            raise QueryError("VERSION_COLUMN_WRITE", "a version is never written", name)
        out[name] = patched(F.col(f"`{name}`"), value, f, df.schema[name].dataType, null_model)
    if model.version and out:
        out[model.version] = (F.coalesce(F.col(model.version), F.lit(0)) + 1).cast(df.schema[model.version].dataType)
    return out
