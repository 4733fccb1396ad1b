"""Declared models: fields, keys, indexes, relations and views.

A model names a table and what its columns mean.  Logical paths (``a.b``) are
what queries use; physical columns (``a__b`` in flattened storage, or a renamed
column) are what the source holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from .errors import QueryError

#: Spark types of the declared design types.
SPARK_TYPES = {
    "string": T.StringType(), "boolean": T.BooleanType(), "number": T.DoubleType(), "double": T.DoubleType(), "float": T.FloatType(),
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "int": T.LongType(),
    "uint8": T.ShortType(), "byte": T.ShortType(), "uint16": T.IntegerType(), "port": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "timestamp": T.TimestampType(), "decimal": T.DecimalType(10, 2), "geopoint": T.ArrayType(T.DoubleType()), "vector": T.ArrayType(T.FloatType()),
    "json": T.StringType(), "currency": T.StringType(), "objectid": T.StringType(),
}
NUMERIC = frozenset("number double float int8 int16 int32 int64 int uint8 byte uint16 port uint32 uint64 decimal".split())


@dataclass(frozen=True)
class Field:
    """One field; nested objects have ``fields``, arrays an ``item`` type or, for objects, ``fields`` and ``array``."""

    name: str
    type: str = "string"
    optional: bool = False
    column: str | None = None
    pk: bool = False
    default: Any = None
    default_fn: str | None = None
    start: int = 1
    collate: str | None = None
    dimension: bool = False
    measure: bool = False
    searchable: bool = False
    weight: float = 1.0
    ignore: bool = False
    json: bool = False
    encrypted: bool = False
    write_only: bool = False
    version: bool = False
    currency_ref: str | None = None
    unit_ref: str | None = None
    precision: tuple[int, int] | None = None
    merge: bool = False
    array: bool = False
    keys: tuple[str, ...] = ()
    unique_items: bool = False
    filterable: bool = True
    sortable: bool = True
    dims: int | None = None
    metric: str = "cosine"
    threshold: float | None = None
    fields: tuple["Field", ...] = ()

    def spark_type(self) -> T.DataType:
        if self.encrypted or self.json:
            return T.StringType()
        if self.fields:
            inner: T.DataType = T.StructType([T.StructField(f.name, f.spark_type()) for f in self.fields if not f.ignore])
        elif self.type == "decimal" and self.precision:
            inner = T.DecimalType(*self.precision)
        else:
            inner = SPARK_TYPES[self.type]
        return T.ArrayType(inner) if self.array else inner


@dataclass(frozen=True)
class ForeignKey:
    fields: tuple[str, ...]
    target: str
    target_fields: tuple[str, ...]
    alias: str | None = None
    on_delete: str = "noAction"
    on_update: str = "noAction"


@dataclass(frozen=True)
class Relation:
    """``to``: a local key; ``from``: a key of the target; ``via``: a junction table."""

    name: str
    kind: str
    target: str
    alias: str | None = None
    many: bool = True
    junction: str | None = None
    filter: dict | None = None


@dataclass(frozen=True)
class Index:
    name: str
    kind: str
    fields: tuple[str, ...]
    weights: tuple[float, ...] = ()
    strategy: str = "text"
    fuzzy: int = 0


@dataclass(frozen=True)
class Model:
    name: str
    fields: tuple[Field, ...]
    table: str | None = None
    fks: tuple[ForeignKey, ...] = ()
    relations: tuple[Relation, ...] = ()
    indexes: tuple[Index, ...] = ()
    flattened: bool = False
    depth_limit: int = 3
    preferred_id: str | None = None
    filterable: str = "auto"
    sortable: str = "auto"
    renamed_from: str | None = None
    by_name: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        self.by_name.update({f.name: f for f in self.fields})
        keys = [f for f in self.fields if f.version]
        if len(keys) > 1:
            raise QueryError("INVALID_QUERY", "a model has one version column at most", self.name)
        for f in self.fields:
            if f.encrypted and (f.pk or f.version or f.merge or f.default_fn or any(f.name in k.fields for k in self.fks) or any(f.name in i.fields for i in self.indexes)):
                raise QueryError("INVALID_QUERY", "an encrypted field can't be a key, indexed, versioned, merged or generated", f.name)
        for i in self.indexes:
            if i.kind == "geo" and (len(i.fields) != 1 or self.by_name.get(i.fields[0], Field("")).type != "geopoint"):
                raise QueryError("INVALID_QUERY", "a geo index needs one top-level point", i.name)

    @property
    def source(self) -> str:
        return self.table or self.name

    @property
    def pk(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields if f.pk)

    @property
    def version(self) -> str | None:
        return next((f.name for f in self.fields if f.version), None)

    @property
    def dimensions(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields if f.dimension)

    @property
    def measures(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields if f.measure)

    @property
    def all_indexes(self) -> tuple[Index, ...]:
        """Declared indexes and a plain one for each dimension that has none."""
        held = {f for i in self.indexes if len(i.fields) == 1 for f in i.fields}
        return self.indexes + tuple(Index(f"{d}_dim", "plain", (d,)) for d in self.dimensions if d not in held)

    def find(self, path: str) -> Field | None:
        """The field at a logical path."""
        at: Field | None = None
        fields = self.by_name
        for part in path.split("."):
            at = fields.get(part)
            if at is None:
                return None
            fields = {f.name: f for f in at.fields}
        return at

    def identifications(self) -> list[tuple[str, ...]]:
        """The primary key and each unique index."""
        return ([self.pk] if self.pk else []) + [i.fields for i in self.indexes if i.kind == "unique"]

    def relation(self, name: str) -> Relation | None:
        return next((r for r in self.relations if r.name == name), None)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type()) for f in self.fields if not f.ignore])

    def leaves(self) -> list[tuple[str, str, Field]]:
        """(logical path, physical column, field) of each stored column in flattened storage."""
        out: list[tuple[str, str, Field]] = []

        def walk(fields: tuple[Field, ...], path: str, column: str) -> None:
            for f in fields:
                if f.ignore:
                    continue
                if f.fields and not f.array and not f.json:
                    if f.column:
                        raise QueryError("INVALID_QUERY", "a flattened object can't be renamed", path + f.name)
                    walk(f.fields, f"{path}{f.name}.", f"{column}{f.name}__")
                else:
                    out.append((path + f.name, column + (f.column or f.name), f))

        walk(self.fields, "", "")
        return out

    def with_fields(self, **changes: Field) -> "Model":
        return replace(self, fields=tuple(changes.get(f.name, f) for f in self.fields), by_name={})


@dataclass(frozen=True)
class JoinSpec:
    """A joined table and its condition: a filter tree or a query expression over ``Table.field``."""

    target: str
    on: Any
    how: str = "inner"


@dataclass(frozen=True)
class ViewColumn:
    """An output column: a source field ``Table.field``, or an aggregate of one."""

    name: str
    source: str
    agg: str | None = None


@dataclass(frozen=True)
class View:
    """A managed view (``entry`` given) or an external one."""

    name: str
    columns: tuple[ViewColumn, ...] = ()
    entry: str | None = None
    joins: tuple[JoinSpec, ...] = ()
    filter: Any = None
    having: Any = None
    materialized: bool = False
    schema: T.StructType | None = None


Provider = Callable[..., Any]
