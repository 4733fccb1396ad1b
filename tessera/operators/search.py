"""Text, vector and geo search over tables."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions import geo, text, vector
from ..model import Index, Model
from ..plans.guards import guard_geo
from ..plans.paths import column, type_at
from ..plans.sorting import page, sort_columns

#: What is returned where no limit is given.
VECTOR_LIMIT, VECTOR_LIMIT_SKIPPED = 20, 1000


def text_index(model: Model, name: str | None) -> Index:
    found = [i for i in model.indexes if name is None and i.kind == "fulltext" or i.name == name]
    if not found:
        raise QueryError("INVALID_QUERY", "no such search index", name or model.name)
    if found[0].kind != "fulltext":
        raise QueryError("INVALID_QUERY", "not a text index", found[0].name)
    return found[0]


def indexed_text(schema: T.StructType, path: str) -> Column:
    """The text at a path, also inside arrays of objects, however deep."""
    def walk(value: Column, kind: T.DataType, rest: list[str]) -> Column:
        if isinstance(kind, T.ArrayType):
            inner = F.transform(value, lambda x: walk(x, kind.elementType, rest))
            return F.array_join(inner, " ")
        if not rest:
            return value.cast("string")
        if not isinstance(kind, T.StructType) or rest[0] not in kind.fieldNames():
            raise QueryError("INVALID_QUERY", "unknown field", path)
        return walk(value[rest[0]], kind[rest[0]].dataType, rest[1:])

    head, *rest = path.split(".")
    if type_at(schema, head) is None:
        raise QueryError("INVALID_QUERY", "unknown field", path)
    return walk(column(head), schema[head].dataType, rest)


def search(df: DataFrame, model: Model, query: str, *, index: str | None = None, mode: str = "all", fuzzy: int | None = None) -> DataFrame:
    """Rows that match a text, with ``_score``.

    ``all``: every token must occur; ``any``: one must.  The score adds, for each
    token, its occurrences in each field times the field's weight.  A text without
    tokens matches nothing.
    """
    used = text_index(model, index)
    wanted = list(dict.fromkeys(text.query_tokens(query)))
    fuzzy = used.fuzzy if fuzzy is None else fuzzy
    if fuzzy not in (0, 1, 2):
        raise QueryError("INVALID_QUERY", "0 to 2 edits", "$fuzzy")
    if not wanted:
        return df.where(F.lit(False)).withColumn("_score", F.lit(0.0))
    fields = {f"__t{i}": text.tokens(F.coalesce(indexed_text(df.schema, p), F.lit(""))) for i, p in enumerate(used.fields)}
    weights = used.weights or (1.0,) * len(used.fields)
    if not fuzzy:
        # Cheap and implied by a match: a token's letters occur in the text, so few texts are split into tokens.
        whole = F.lower(F.concat_ws(" ", *[indexed_text(df.schema, p) for p in used.fields]))
        df = df.where(reduce(lambda a, b: a & b if mode == "all" else a | b, [F.contains(whole, F.lit(t)) for t in wanted]))
    rows = df.withColumns(fields)
    held = F.concat(*[F.col(c) for c in fields])
    found = [text.matches(held, t, used.strategy, fuzzy) for t in wanted]
    rows = rows.where(reduce(lambda a, b: a & b if mode == "all" else a | b, found))
    score = reduce(lambda a, b: a + b, [text.frequency(F.col(c), t, fuzzy) * F.lit(float(w)) for c, w in zip(fields, weights) for t in wanted])
    return rows.withColumn("_score", score.cast("double")).drop(*fields)


def search_fallback(df: DataFrame, fields: list[str], query: str) -> DataFrame:
    """Without an index: the text occurs literally, in any case, in one of the searchable fields."""
    return df.where(text.any_contains([column(f, df.schema).cast("string") for f in fields], query))


def ordered_page(df: DataFrame, controls: dict, default: list[Column], limit: int | None) -> DataFrame:
    order = sort_columns(controls.get("$sort"), df.schema) or default
    return page(df.orderBy(*order) if order else df, controls.get("$skip"), controls.get("$limit", limit))


def vector_field(model: Model, index: str | None) -> Any:
    named = next((i.fields[0] for i in model.indexes if i.kind == "vector" and i.name == index), index)
    found = [f for f in model.fields if f.type == "vector" and named in (None, f.name)]
    if not found:
        raise QueryError("INVALID_QUERY", "no such vector index", index or model.name)
    return found[0]


def vector_matches(df: DataFrame, model: Model, query: list[float], controls: dict, index: str | None = None) -> DataFrame:
    """Rows (already filtered) with ``_distance``, within the threshold."""
    f = vector_field(model, index)
    if f.dims is not None and len(query) != f.dims:
        raise QueryError("INVALID_QUERY", f"the vector has {len(query)} components, not {f.dims}", f.name)
    rows = df.where(column(f.name).isNotNull()).withColumn("_distance", vector.distance(column(f.name), query, f.metric))
    threshold = controls.get("$threshold", f.threshold)
    rows = rows.where(F.col("_distance").isNotNull())
    return rows if threshold is None else rows.where(F.col("_distance") <= vector.farthest(float(threshold), f.metric))


def vector_search(df: DataFrame, model: Model, query: list[float], controls: dict, index: str | None = None) -> DataFrame:
    """The nearest rows first; ties by key.  An exact scan: the filter applies before ranking."""
    limit = VECTOR_LIMIT_SKIPPED if controls.get("$skip") else VECTOR_LIMIT
    return ordered_page(vector_matches(df, model, query, controls, index), {k: v for k, v in controls.items() if k != "$sort"}, [F.col("_distance").asc(), *[column(k) for k in model.pk]], limit)


def geo_matches(df: DataFrame, model: Model, controls: dict, index: str | None = None) -> DataFrame:
    """Rows (already filtered) with ``$distance`` in metres, within the window; null points are left out."""
    path, center, least, most = guard_geo(controls, model, index)
    point = column(path)
    rows = df.where(point.isNotNull())
    if most is not None:
        rows = rows.where(geo.bounding_box(point, center, float(most)))
    rows = rows.withColumn("$distance", geo.haversine(point, center)).where(F.col("`$distance`").isNotNull())
    if least is not None:
        rows = rows.where(F.col("`$distance`") >= float(least))
    return rows if most is None else rows.where(F.col("`$distance`") <= float(most))


def geo_search(df: DataFrame, model: Model, controls: dict, index: str | None = None) -> DataFrame:
    rows = geo_matches(df, model, controls, index)
    return page(rows.orderBy(F.col("`$distance`").asc(), *[column(k) for k in model.pk]), controls.get("$skip"), controls.get("$limit"))
