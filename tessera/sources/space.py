"""A space: the registry of tables and views, and the API to read and write them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import crypto
from ..model import Field, Model, View
from ..operators import search as searching
from ..operators import views, writes
from ..operators.integrity import check_foreign_keys
from ..operators.integrity import delete as delete_with_effects
from ..operators.relations import join_keys, with_relations
from ..plans.aggregate import aggregate
from ..plans.filters import apply_filter
from ..plans.guards import guard
from ..plans.select import project
from ..plans.sorting import page, sort_columns
from . import readers


class Readable:
    """A table or view with the read API.  Every method returns a lazy DataFrame."""

    def __init__(self, space: "Space", model: Model, source: Callable[[], DataFrame], null_model: str = "sql", read_only: bool = False):
        self.space, self.model, self.source, self.null_model, self.read_only = space, model, source, null_model, read_only

    # frames -------------------------------------------------------------
    def frame(self) -> DataFrame:
        df = readers.logical(self.source(), self.model)
        if self.space.key is not None:
            for f in self.model.fields:
                if f.encrypted and f.name in df.columns:
                    df = df.withColumn(f.name, crypto.decrypt(F.col(f"`{f.name}`"), self.space.key))
        return df

    def collations(self) -> dict[str, str]:
        return {f.name: f.collate for f in self.model.fields if f.collate}

    def hidden(self) -> tuple[str, ...]:
        """Fields that no read returns."""
        return tuple(f.name for f in self.model.fields if f.write_only)

    def filtered(self, query: dict | None) -> DataFrame:
        """The rows that a filter matches: every read, count, group and relation goes by here."""
        query = query or {}
        guard(query, self.model)
        return apply_filter(self.frame(), query.get("filter"), self.null_model, self.collations())

    def _finish(self, df: DataFrame, controls: dict, extra: tuple[str, ...] = (), order: list[Column] | None = None) -> DataFrame:
        """Relations, then the order that their joins have lost, then the projection with the columns it has to keep."""
        specs = controls.get("$with") or []
        df = with_relations(df, specs, self.model, self.space)
        if specs and order:
            df = df.orderBy(*order)
        hidden = self.hidden()
        nested = tuple(s if isinstance(s, str) else s["name"] for s in specs)
        keys = join_keys(specs, self.model, self.space)
        keep = [*extra, *keys, *nested]
        if self.null_model == "document":
            keep = [*self.model.pk, *keep]
        select = controls.get("$select")
        named = [s for s in select if isinstance(s, str)] if isinstance(select, (list, tuple)) else list(select or {})
        dropped = [n[1:] for n in named if n.startswith("-")] if isinstance(select, (list, tuple)) else [n for n, on in (select or {}).items() if not on]
        if lost := [k for k in keys if k in dropped]:
            raise QueryError("INVALID_QUERY", "a relation needs this field", lost[0])
        for name in named:
            f = self.model.find(name.removeprefix("-"))
            keep += [r for r in (f.currency_ref, f.unit_ref) if r] if f is not None else []
        return project(df, select, keep=tuple(dict.fromkeys(k for k in keep if k in df.columns)), hidden=hidden)

    # reads --------------------------------------------------------------
    def find_many(self, query: dict | None = None) -> DataFrame:
        controls = (query or {}).get("controls") or {}
        df = self.filtered(query)
        order = sort_columns(controls.get("$sort"), df.schema, self.model.pk)
        cut = controls.get("$skip") or controls.get("$limit") is not None
        # Where relations follow and nothing is cut, sorting once, after them, is enough.
        df = df.orderBy(*order) if order and (cut or not controls.get("$with")) else df
        df = page(df, controls.get("$skip"), controls.get("$limit"))
        return self._finish(df, controls, order=order)

    def find_one(self, query: dict | None = None) -> DataFrame:
        query = dict(query or {})
        query["controls"] = {**(query.get("controls") or {}), "$limit": 1}
        return self.find_many(query)

    def count(self, query: dict | None = None) -> DataFrame:
        return self.filtered({"filter": (query or {}).get("filter")}).agg(F.count(F.lit(1)).alias("count"))

    def find_many_with_count(self, query: dict | None = None) -> tuple[DataFrame, DataFrame]:
        return self.find_many(query), self.count(query)

    def pages(self, query: dict | None = None) -> dict[str, Any]:
        """One page with its number, size, the number of pages and of rows."""
        query = dict(query or {})
        controls = dict(query.get("controls") or {})
        number, size = controls.pop("$page", 1), controls.pop("$size", 10)
        total = self.count(query).first()["count"]
        query["controls"] = {**controls, "$skip": (number - 1) * size, "$limit": size}
        return {"data": self.find_many(query), "page": number, "itemsPerPage": size, "pages": -(-total // size), "count": total}

    def aggregate(self, query: dict, rows: DataFrame | None = None) -> DataFrame:
        """A grouped query over the table, or over rows of it that a search has found."""
        found = self.filtered(query) if rows is None else rows
        return aggregate(found, {k: v for k, v in query.items() if k != "filter"}, self.model, self.null_model)

    # identification -----------------------------------------------------
    def id_filter(self, id: Any) -> dict | None:
        """The filter that an id stands for: keys and unique indexes whose types it fits."""
        ways = self.model.identifications()
        if self.model.preferred_id:
            ways = [i.fields for i in self.model.indexes if i.name == self.model.preferred_id]
        found = []
        for fields in ways:
            if isinstance(id, dict):
                if set(fields) <= set(id):
                    found.append({k: id[k] for k in fields})
            elif len(fields) == 1 and (value := self._fitting(self.model.find(fields[0]), id)) is not None:
                found.append({fields[0]: value})
        if not found:
            return None
        return found[0] if len(found) == 1 else {"$or": found}

    @staticmethod
    def _fitting(f: Field | None, id: Any) -> Any:
        if f is None:
            return None
        if f.type in ("string", "objectid", "currency"):
            return str(id) if isinstance(id, (str, int)) else None
        if isinstance(id, (int, float)):
            return id
        try:
            return int(id)
        except (TypeError, ValueError):
            return None

    def find_by_id(self, id: Any, controls: dict | None = None) -> DataFrame:
        filter = self.id_filter(id)
        if filter is None:
            return self.frame().where(F.lit(False))
        return self.find_one({"filter": filter, "controls": controls or {}})

    # searches -----------------------------------------------------------
    def search(self, text: str, query: dict | None = None, index: str | None = None, mode: str = "all") -> DataFrame:
        """Best matches first, ties by key."""
        controls = (query or {}).get("controls") or {}
        found = self._searched(text, query, index, mode)
        default = [F.col("_score").desc(), *[F.col(f"`{k}`") for k in self.model.pk]]
        return self._ordered(found, controls, default, ("_score",))

    def _searched(self, text: str, query: dict | None, index: str | None = None, mode: str = "all") -> DataFrame:
        controls = (query or {}).get("controls") or {}
        return searching.search(self.filtered(query), self.model, text, index=index or controls.get("$index"), mode=mode, fuzzy=controls.get("$fuzzy"))

    def _ordered(self, found: DataFrame, controls: dict, default: list[Column], extra: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
        order = sort_columns(controls.get("$sort"), found.schema, self.model.pk) or default
        return self._finish(searching.ordered_page(found, controls, default, limit), controls, extra, order)

    def search_count(self, text: str, query: dict | None = None, index: str | None = None, mode: str = "all") -> DataFrame:
        return self._searched(text, query, index, mode).agg(F.count(F.lit(1)).alias("count"))

    def _searched_plain(self, text: str, query: dict | None) -> DataFrame:
        return searching.search_fallback(self.filtered(query), [f.name for f in self.model.fields if f.searchable], text)

    def search_plain(self, text: str, query: dict | None = None) -> DataFrame:
        """The fallback where no text index is declared."""
        controls = (query or {}).get("controls") or {}
        return self._ordered(self._searched_plain(text, query), controls, [F.col(f"`{k}`") for k in self.model.pk])

    def found(self, text: str, query: dict | None = None) -> DataFrame:
        """The rows that a text finds, by the index or, where there is none, by the fallback; neither ordered nor cut."""
        return self._searched(text, query).drop("_score") if self.meta()["searchable"] else self._searched_plain(text, query)

    def vector_search(self, vector: list[float], query: dict | None = None, index: str | None = None) -> DataFrame:
        controls = (query or {}).get("controls") or {}
        order = [F.col("_distance").asc(), *[F.col(f"`{k}`") for k in self.model.pk]]
        return self._finish(searching.vector_search(self.filtered(query), self.model, vector, controls, index), controls, ("_distance",), order)

    def vector_count(self, vector: list[float], query: dict | None = None, index: str | None = None) -> DataFrame:
        controls = (query or {}).get("controls") or {}
        return searching.vector_matches(self.filtered(query), self.model, vector, controls, index).agg(F.count(F.lit(1)).alias("count"))

    def geo_search(self, point: list[float], query: dict | None = None, index: str | None = None) -> DataFrame:
        controls = {**((query or {}).get("controls") or {}), "$center": point}
        order = [F.col("`$distance`").asc(), *[F.col(f"`{k}`") for k in self.model.pk]]
        return self._finish(searching.geo_search(self.filtered(query), self.model, controls, index), controls, ("$distance",), order)

    def geo_count(self, point: list[float], query: dict | None = None, index: str | None = None) -> DataFrame:
        controls = {**((query or {}).get("controls") or {}), "$center": point}
        return searching.geo_matches(self.filtered(query), self.model, controls, index).agg(F.count(F.lit(1)).alias("count"))

    def meta(self) -> dict[str, Any]:
        """What the table can do, and its fields."""
        kinds = {i.kind for i in self.model.indexes}
        return {
            "name": self.model.name, "pk": list(self.model.pk), "readOnly": self.read_only, "version": self.model.version,
            "searchable": "fulltext" in kinds, "vectorSearchable": any(f.type == "vector" for f in self.model.fields), "geoSearchable": "geo" in kinds,
            "searchIndexes": [i.name for i in self.model.indexes if i.kind in ("fulltext", "vector", "geo")],
            "relations": [{"name": r.name, "kind": r.kind, "target": r.target} for r in self.model.relations],
            "fields": [{"name": f.name, "type": f.type, "optional": f.optional, "filterable": f.filterable and not f.encrypted, "sortable": f.sortable and not f.encrypted} for f in self.model.fields if not f.write_only],
        }


class Table(Readable):
    """A table that can be written.  Each write returns the table's next rows; ``commit`` stores them."""

    def _writable(self) -> None:
        if self.read_only:
            raise QueryError("CONFLICT", "the table is read-only", self.model.name)

    def _new(self, rows: DataFrame | list[dict]) -> DataFrame:
        self._writable()
        if isinstance(rows, DataFrame):
            return rows
        names = list(dict.fromkeys(k for r in rows for k in r))
        schema = self.model.schema()
        from pyspark.sql import types as T

        return self.space.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], T.StructType([schema[n] for n in names]))

    def insert(self, rows: DataFrame | list[dict], *, check: bool = True) -> DataFrame:
        new = writes.with_defaults(self._new(rows), self.model, self.frame())
        out = self.frame().unionByName(new)
        if check:
            self._checked(new, out, set(new.columns))
        return out

    def _checked(self, new: DataFrame, out: DataFrame, changed: set[str]) -> None:
        """Refuses written rows (``new``, also in ``out``) that break the model in one of the fields that changed."""
        bad = writes.violations(new, self.model, changed).select("problem").first()
        if bad is not None:
            raise QueryError("INVALID_QUERY", bad["problem"], self.model.name)
        twice = writes.duplicates(out, self.model, new, changed)
        twice = twice.first() if twice is not None else None
        if twice is not None:
            raise QueryError("CONFLICT", f"{twice['constraint']} {twice['values']}", self.model.name)
        if any(changed & set(fk.fields) for fk in self.model.fks):
            broken = check_foreign_keys(new, self.space, self.model.name).first()
            if broken is not None:
                raise QueryError("FK_VIOLATION", f"{broken['constraint']} {broken['values']}", self.model.name)

    def _changed(self, filter: Any, changes: dict, check: bool) -> DataFrame:
        """The table after a patch of all rows that a filter matches."""
        self._writable()
        guard({"filter": filter}, self.model)
        frame = self.frame()
        out = writes.update_many(frame, filter, changes, self.model, self.null_model, self.collations())
        if check:
            hit = writes.update_many(apply_filter(frame, filter, self.null_model, self.collations()), {}, changes, self.model, self.null_model)
            self._checked(hit, out, set(changes))
        return out

    def _by_key(self, new: DataFrame, out: DataFrame, changed: set[str], check: bool) -> DataFrame:
        """The table after rows were matched by key; a key may come once only."""
        twice = new.groupBy(*self.model.pk).agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
        if twice is not None:
            raise QueryError("CONFLICT", f"the key comes {twice['n']} times", str([twice[k] for k in self.model.pk]))
        if check:
            self._checked(out.join(new.select(*self.model.pk), list(self.model.pk), "left_semi"), out, changed)
        return out

    def validate(self, rows: DataFrame | list[dict]) -> DataFrame:
        return writes.violations(writes.with_defaults(self._new(rows), self.model, self.frame()), self.model)

    def replace(self, rows: DataFrame | list[dict], cas: str | None = None, *, check: bool = True) -> DataFrame:
        new = self._new(rows)
        return self._by_key(new, writes.replace_rows(self.frame(), new, self.model, cas=cas), {f.name for f in self.model.fields}, check)

    def update(self, payload: dict | DataFrame, cas: str | None = None, *, nulls: tuple[str, ...] = (), check: bool = True) -> DataFrame:
        """Patches rows by key.  A null in a DataFrame leaves the field as it is, unless ``nulls`` names the column."""
        self._writable()
        if isinstance(payload, DataFrame):
            return self._by_key(payload, writes.update_rows(self.frame(), payload, self.model, cas=cas, nulls=nulls), set(payload.columns) - set(self.model.pk), check)
        filter, changes = writes.identified(payload, self.model)
        return self._changed(filter, changes, check) if changes else self.frame()

    def update_many(self, filter: Any, changes: dict, *, check: bool = True) -> DataFrame:
        return self._changed(filter, changes, check)

    def replace_many(self, filter: Any, row: dict, *, check: bool = True) -> DataFrame:
        """Sets the same values on every row that a filter matches."""
        return self._changed(filter, row, check)

    def delete(self, filter: Any) -> dict[str, DataFrame]:
        """The tables that change, after referential actions; ``Space.commit`` stores them together."""
        self._writable()
        guard({"filter": filter}, self.model)
        return delete_with_effects(self.space, self.model.name, filter)

    def delete_many(self, filter: Any) -> DataFrame:
        self._writable()
        guard({"filter": filter}, self.model)
        return writes.delete_many(self.frame(), filter, self.null_model, self.collations())

    def store(self, rows: DataFrame, path: str) -> None:
        """Writes rows to a new path, encrypted fields sealed; what is there already is never touched."""
        self._writable()
        if readers.exists(self.space.spark, path):
            raise QueryError("CONFLICT", "rows are stored at a new path only", path)
        for f in self.model.fields:
            if f.encrypted:
                rows = rows.withColumn(f.name, crypto.encrypt(F.col(f"`{f.name}`").cast("string"), crypto.check_key(self.space.key)))
        readers.physical(rows, self.model).write.mode("error").parquet(path)

    def commit(self, rows: DataFrame, path: str) -> None:
        """Stores a table's next rows at a new path and, when all are written, reads from there on."""
        self.store(rows, path)
        self.source = lambda: self.space.spark.read.parquet(path)


class Space:
    """Tables and views by name."""

    def __init__(self, spark: SparkSession, root: str | None = None, key: bytes | None = None):
        self.spark, self.root, self.key = spark, root, key
        self._tables: dict[str, Readable] = {}
        #: Filters that requests and relation loads add to every read of a table.
        self.overlays: dict[str, Any] = {}
        self._views: dict[str, View] = {}

    def add(self, model: Model, source: Callable[[], DataFrame] | DataFrame | None = None, *, null_model: str = "sql") -> Table:
        if source is None:
            path = f"{self.root}/{model.source}.parquet"
            read: Callable[[], DataFrame] = lambda: readers.parquet(self.spark, path)
        elif isinstance(source, DataFrame):
            read = lambda: source
        else:
            read = source
        self._tables[model.name] = table = Table(self, model, read, null_model)
        return table

    def add_rows(self, model: Model, rows: list[dict], *, null_model: str = "document") -> Table:
        return self.add(model, readers.rows(self.spark, model, rows), null_model=null_model)

    def add_provider(self, model: Model, provider: Callable[[], Any], *, null_model: str = "document") -> Table:
        table = self.add(model, lambda: readers.provided(provider, self.spark, model), null_model=null_model)
        table.read_only = True
        return table

    def add_view(self, view: View, model: Model | None = None) -> Readable:
        """Registers a view; it is planned anew on each read unless materialised."""
        self._views[view.name] = view
        if model is None:
            frame = views.view_frame(view, self)
            model = Model(view.name, tuple(Field(n, _design(t), optional=True) for n, t in frame.dtypes))
        self._tables[view.name] = readable = Readable(self, model, lambda: views.view_frame(view, self), read_only=True)
        return readable

    def commit(self, frames: dict[str, DataFrame], root: str) -> None:
        """Stores the next rows of several tables as one step.

        Each table goes to a new folder under ``root``; only when all are whole does a
        list of the current folders replace the last one, and are the tables read from
        there.  If anything fails before, every table is as it was.
        """
        current = readers.current(self.spark, root)
        for name, rows in frames.items():
            path = f"{root}/{name}/{uuid.uuid4().hex}"
            self.table(name).store(rows, path)
            current[name] = path
        readers.publish(self.spark, root, current)
        self.attach(root)

    def attach(self, root: str) -> None:
        """Reads the tables that were last committed under ``root`` from there."""
        for name, path in readers.current(self.spark, root).items():
            self.table(name).source = lambda path=path: self.spark.read.parquet(path)

    def refresh(self, name: str, path: str) -> Readable:
        """Materialises a view, or does so again."""
        rows = views.materialize(self._views[name], self, path)
        self._tables[name].source = lambda: rows
        return self._tables[name]

    def table(self, name: str | None) -> Any:
        if name not in self._tables:
            raise QueryError("NOT_FOUND", "no such table", str(name))
        return self._tables[name]

    def table_names(self) -> list[str]:
        return [n for n in self._tables if n not in self._views]

    def drop(self, name: str) -> None:
        self._tables.pop(name, None)
        self._views.pop(name, None)


def _design(kind: str) -> str:
    """A design type for a view's output column."""
    if kind.startswith("decimal"):
        return "decimal"
    return {"bigint": "int64", "int": "int32", "double": "double", "float": "float", "boolean": "boolean", "timestamp": "timestamp", "smallint": "int16", "tinyint": "int8"}.get(kind, "string")
