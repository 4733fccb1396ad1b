"""The request surface: URL text in, lazy tables out.

The same dispatch as an HTTP controller would do: grouped, counted, vector, text
or plain reads, pages, geo search, one row, metadata and writes.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import QueryError
from .operators.actions import Action, augment
from .plans.guards import guard
from .plans.urlquery import parse_url
from .sources.space import Space

#: Fixed value: rows of a plain query that names no limit; ``$limit=none`` asks for all.
DEFAULT_LIMIT = 1000


class Facade:
    def __init__(self, space: Space, name: str, *, overlay: dict | None = None, embed: Callable[[str], list[float]] | None = None, actions: list[Action] | None = None):
        self.space, self.name, self.embed, self.actions = space, name, embed, actions or []
        self.overlay = overlay or space.overlays.get(name)

    @property
    def table(self):
        return self.space.table(self.name)

    def _parsed(self, url: str | dict) -> dict:
        query = parse_url(url) if isinstance(url, str) else url
        query = {"filter": query.get("filter") or {}, "controls": dict(query.get("controls") or {})}
        if self.overlay:
            query["filter"] = {"$and": [query["filter"], self.overlay]} if query["filter"] else self.overlay
        for spec in query["controls"].get("$with") or []:
            name = spec if isinstance(spec, str) else spec["name"]
            if "." not in name and self.table.model.relation(name) is None:
                raise QueryError("INVALID_QUERY", f"unknown relation; there are {[r.name for r in self.table.model.relations]}", name)
        return query

    def query(self, url: str | dict) -> DataFrame:
        query = self._parsed(url)
        controls = query["controls"]
        if controls.get("$groupBy") or any(isinstance(s, dict) for s in controls.get("$select") or []):
            text = controls.pop("$search", None)
            return self.table.aggregate(query, self.table.found(text, query) if text else None)
        if controls.get("$count"):
            return self._count(query)
        actions = controls.pop("$actions", False)
        controls.setdefault("$limit", DEFAULT_LIMIT)
        found = self._rows(query)
        return augment(found, self.actions) if actions else found

    def _by_vector(self, controls: dict) -> bool:
        if "$vector" not in controls and not (controls.get("$search") and self.embed and not self.table.meta()["searchable"]):
            return False
        if self.embed is None:
            raise QueryError("INVALID_QUERY", "no embedding is configured", "$vector")
        return True

    def _rows(self, query: dict) -> DataFrame:
        """The rows of a request, by vector, text or filter alone."""
        controls = dict(query["controls"])
        query = {**query, "controls": controls}
        if self._by_vector(controls):
            index = controls.pop("$vector", None) or None
            return self.table.vector_search(self.embed(controls.pop("$search", "")), query, index)
        if controls.get("$search"):
            text = controls.pop("$search")
            return self.table.search(text, query) if self.table.meta()["searchable"] else self.table.search_plain(text, query)
        return self.table.find_many(query)

    def _count(self, query: dict) -> DataFrame:
        """How many rows a request has, whatever its page."""
        controls = dict(query["controls"])
        query = {"filter": query["filter"], "controls": controls}
        if self._by_vector(controls):
            index = controls.pop("$vector", None) or None
            return self.table.vector_count(self.embed(controls.pop("$search", "")), query, index)
        text = controls.pop("$search", None)
        return self.table.found(text, query).agg(F.count(F.lit(1)).alias("count")) if text else self.table.count(query)

    def pages(self, url: str | dict) -> dict[str, Any]:
        """One page of a request, with its number, size, the number of pages and of rows."""
        query = self._parsed(url)
        controls = query["controls"]
        number, size = controls.pop("$page", 1), controls.pop("$size", 10)
        guard({"controls": {"$page": number, "$size": size}}, self.table.model)
        total = self._count(query).first()["count"]
        controls |= {"$skip": (number - 1) * size, "$limit": size}
        return {"data": self._rows(query), "page": number, "itemsPerPage": size, "pages": -(-total // size), "count": total}

    def geo(self, url: str | dict) -> DataFrame:
        query = self._parsed(url)
        center = query["controls"].pop("$center", None)
        if center is None:
            raise QueryError("INVALID_QUERY", "needs $center", "$center")
        query["controls"].setdefault("$limit", DEFAULT_LIMIT)
        return self.table.geo_search(center, query, query["controls"].pop("$index", None))

    def one(self, id: Any, url: str = "") -> DataFrame:
        query = self._parsed(url)
        if query["filter"] and query["filter"] != self.overlay:
            raise QueryError("INVALID_QUERY", "one row takes no filter", self.name)
        found = self.table.id_filter(id)
        if found is None:
            raise QueryError("NOT_FOUND", "the id fits no key", str(id))
        return self.table.find_one({"filter": {"$and": [found, self.overlay]} if self.overlay else found, "controls": query["controls"]})

    def meta(self) -> dict[str, Any]:
        return self.table.meta() | {"actions": [a.name for a in self.actions]}

    def write(self, method: str, payload: Any) -> Any:
        """POST inserts, PUT replaces, PATCH updates, DELETE deletes; a version in the payload must still hold."""
        table = self.table
        if method == "POST":
            return table.insert(payload if isinstance(payload, list) else [payload])
        if method == "DELETE":
            found = table.id_filter(payload)
            if found is None:
                raise QueryError("NOT_FOUND", "the id fits no key", str(payload))
            return table.delete(found)
        payload = dict(payload)
        version = table.model.version
        expected = payload.pop(version, None) if version else None
        keys = {k: payload[k] for k in table.model.pk}
        filter = {**keys, **({version: expected} if expected is not None else {})}
        if table.frame().limit(1).count() and not table.filtered({"filter": filter}).limit(1).count():
            raise QueryError("CONFLICT" if table.filtered({"filter": keys}).limit(1).count() else "NOT_FOUND", "the version has moved on, or the row is gone", self.name)
        if method == "PUT":
            return table.replace([payload | ({version: expected} if expected is not None else {})], cas=version if expected is not None else None)
        if method == "PATCH":
            return table.update(payload | ({"$cas": expected} if expected is not None else {}))
        raise QueryError("INVALID_QUERY", "unknown method", method)
