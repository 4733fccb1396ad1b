"""Checks that a query passes before it is planned."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

from ..errors import QueryError
from ..functions.geo import check_point
from ..model import Model
from .sorting import parse_sort

CONTROLS = frozenset("$sort $skip $limit $page $size $select $count $with $groupBy $having $search $index $fuzzy $vector $threshold $center $maxDistance $minDistance $actions".split())


def filter_paths(expr: Any) -> Iterator[tuple[str, Any]]:
    """(path, condition) of every leaf of a filter."""
    if not isinstance(expr, dict):
        return
    for key, value in expr.items():
        if key in ("$and", "$or"):
            for x in value:
                yield from filter_paths(x)
        elif key == "$not":
            yield from filter_paths(value)
        else:
            yield key, value


def guard(query: dict, model: Model) -> None:
    """Encrypted fields can't be filtered or sorted; manual gates, points and controls are checked."""
    controls = query.get("controls") or {}
    for name in controls:
        if name not in CONTROLS:
            raise QueryError("INVALID_QUERY", "unknown control", name)
    for path, condition in filter_paths(query.get("filter")):
        f = model.find(path)
        if f is None:
            raise QueryError("INVALID_QUERY", "unknown field", path)
        if f.encrypted:
            raise QueryError("ENC_FIELD_FILTER", "an encrypted field can't be filtered", path)
        if not f.filterable or f.json or model.filterable == "manual" and not f.searchable and not f.dimension and not f.pk:
            raise QueryError("INVALID_QUERY", "the field can't be filtered", path)
        if isinstance(condition, dict) and "$geoWithin" in condition:
            if f.type != "geopoint":
                raise QueryError("GEO_NOT_SUPPORTED", "not a point", path)
            circle = condition["$geoWithin"]
            check_point(circle.get("center"), path)
            radius = circle.get("radius")
            if not isinstance(radius, (int, float)) or not math.isfinite(radius) or radius < 0:
                raise QueryError("INVALID_QUERY", "a radius is finite and not negative", path)
        elif f.type == "geopoint" and not (isinstance(condition, dict) and set(condition) <= {"$exists"}) and condition is not None:
            raise QueryError("FILTER_TYPE_MISMATCH", "a point only takes $geoWithin and $exists", path)
    for path, _ in parse_sort(controls.get("$sort")):
        f = model.find(path)
        if f is not None and f.encrypted:
            raise QueryError("ENC_FIELD_SORT", "an encrypted field can't be sorted", path)
        if f is not None and (not f.sortable or f.json):
            raise QueryError("INVALID_QUERY", "the field can't be sorted", path)
    for name in ("$skip", "$limit", "$page", "$size"):
        value = controls.get(name)
        if value is not None and (not isinstance(value, int) or value < (1 if name in ("$page", "$size") else 0)):
            raise QueryError("INVALID_QUERY", "not a count", name)


def guard_geo(controls: dict, model: Model, index: str | None = None) -> tuple[str, tuple[float, float], float | None, float | None]:
    """The point field, center and distances of a geo search."""
    if controls.get("$sort"):
        raise QueryError("INVALID_QUERY", "a geo search is ordered by distance", "$sort")
    geo = [i for i in model.indexes if i.kind == "geo" and (index is None or i.name == index)]
    if not geo:
        raise QueryError("GEO_INDEX_MISSING", "no such geo index", index or model.name)
    bounds = []
    for name in ("$minDistance", "$maxDistance"):
        value = controls.get(name)
        if value is not None and (isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value < 0):
            raise QueryError("INVALID_QUERY", "a distance is finite and not negative", name)
        bounds.append(value)
    return geo[0].fields[0], check_point(controls.get("$center"), "$center"), bounds[0], bounds[1]
