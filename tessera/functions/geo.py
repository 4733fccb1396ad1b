"""Distances on the sphere."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError

#: Metres; half of it is the radius that distances are computed with.
EARTH_DIAMETER = 12_742_000.0


def check_point(point: Any, path: str = "") -> tuple[float, float]:
    """A finite (longitude, latitude) within bounds."""
    ok = isinstance(point, (list, tuple)) and len(point) == 2 and all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) for x in point)
    if not ok or not (-180 <= point[0] <= 180 and -90 <= point[1] <= 90):
        raise QueryError("INVALID_QUERY", "a point is [lng, lat] within ±180 and ±90", path)
    return float(point[0]), float(point[1])


def valid_point(point: Column) -> Column:
    return (F.size(point) == 2) & F.element_at(point, 1).between(-180, 180) & F.element_at(point, 2).between(-90, 90)


def haversine(point: Column, center: tuple[float, float]) -> Column:
    """Metres between a [lng, lat] column and a point; null for null or short arrays."""
    lng, lat = F.radians(F.try_element_at(point, F.lit(1))), F.radians(F.try_element_at(point, F.lit(2)))
    lng0, lat0 = math.radians(center[0]), math.radians(center[1])
    a = F.pow(F.sin((lat - lat0) / 2), 2) + F.cos(lat) * math.cos(lat0) * F.pow(F.sin((lng - lng0) / 2), 2)
    return EARTH_DIAMETER * F.asin(F.when(a > 1, 1.0).otherwise(F.sqrt(a)))  # least() would skip nulls


def bounding_box(point: Column, center: tuple[float, float], metres: float) -> Column:
    """A cheap necessary condition for being within a distance, before the exact one."""
    degrees = math.degrees(metres / (EARTH_DIAMETER / 2)) * 1.0001
    near = F.abs(F.try_element_at(point, F.lit(2)) - center[1]) <= degrees
    reach = abs(center[1]) + degrees
    if reach >= 90:
        return near
    wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(min(90.0, degrees))) / math.cos(math.radians(center[1]))))) * 1.0001
    apart = F.abs(F.try_element_at(point, F.lit(1)) - center[0])
    return near & (F.least(apart, 360 - apart) <= wide)
