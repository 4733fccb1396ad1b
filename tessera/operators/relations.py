"""Nested relations (``$with``): joins that attach structs or arrays of structs.

Parents are paged before this; each relation is one plan over the target, sorted
and cut within each parent by a window, so nothing is looked up row by row.
"""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import QueryError
from ..model import ForeignKey, Model, Relation
from ..plans.filters import apply_filter
from ..plans.select import project
from ..plans.sorting import sort_columns

if TYPE_CHECKING:
    from ..sources.space import Space


def foreign_key(owner: Model, target: str, alias: str | None) -> ForeignKey:
    """The key by alias, else the first that points to the target."""
    for fk in owner.fks:
        if alias is not None and fk.alias == alias or alias is None and fk.target == target:
            return fk
    raise QueryError("INVALID_QUERY", f"no foreign key to {target}", alias or owner.name)


def spec_parts(spec: Any, relation: Relation) -> tuple[dict, dict]:
    """The filter and the controls of one ``$with`` entry; nested controls win over flat ones."""
    if isinstance(spec, str):
        spec = {"name": spec}
    flat = {k: v for k, v in spec.items() if k.startswith("$")}
    controls = {**flat, **(spec.get("controls") or {})}
    filters = [f for f in (spec.get("filter"), controls.pop("$filter", None), relation.filter) if f]
    return ({"$and": filters} if len(filters) > 1 else filters[0] if filters else {}), controls


def _target(space: "Space", relation: Relation, spec: Any, keys: tuple[str, ...]) -> tuple[DataFrame, dict, list[str] | None]:
    """Filtered target rows with their own relations, and the columns that the caller selected."""
    filters, controls = spec_parts(spec, relation)
    table = space.table(relation.target)
    rows = table.filtered({"filter": filters, "controls": {k: v for k, v in controls.items() if k != "$with"}})
    rows = apply_filter(rows, space.overlays.get(relation.target), table.null_model, table.collations())
    if controls.get("$with"):
        rows = with_relations(rows, controls["$with"], table.model, space)
    chosen = None
    if controls.get("$select"):
        nested = tuple(s if isinstance(s, str) else s["name"] for s in controls.get("$with") or [])
        chosen = project(rows, controls["$select"], keep=(*keys, *nested), hidden=table.hidden()).columns
    elif table.hidden():
        chosen = [c for c in rows.columns if c not in table.hidden()]
    return rows, controls, chosen


def _value(rows: DataFrame, chosen: list[str] | None) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in (chosen or rows.columns)])


def _gathered(rows: DataFrame, keys: list[Column], names: list[str], value: Column, controls: dict, model: Model, many: bool) -> DataFrame:
    """One row for each key: its targets in order, cut by skip and limit within the key."""
    order = sort_columns(controls.get("$sort"), rows.schema, model.pk) or [F.col(f"`{k}`").asc_nulls_first() for k in model.pk] or [F.xxhash64(value).asc()]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    skip, limit = int(controls.get("$skip") or 0), controls.get("$limit")
    rows = rows.select(*[k.alias(n) for k, n in zip(keys, names)], value.alias("__value"), rank.alias("__rank"))
    rows = rows.where(" AND ".join(f"{n} IS NOT NULL" for n in names))
    if not many:
        return rows.where(F.col("__rank") == 1 + skip).drop("__rank")
    if skip or limit is not None:
        rows = rows.where(F.col("__rank") > skip)
        rows = rows if limit is None else rows.where(F.col("__rank") <= skip + int(limit))
    held = F.array_sort(F.collect_list(F.struct("__rank", "__value")))
    return rows.groupBy(*names).agg(F.transform(held, lambda x: x["__value"]).alias("__value"))


def attach(parents: DataFrame, spec: Any, model: Model, space: "Space") -> DataFrame:
    name = spec if isinstance(spec, str) else spec["name"]
    if "." in name:
        return parents
    relation = model.relation(name)
    if relation is None:
        raise QueryError("INVALID_QUERY", f"unknown relation; there are {[r.name for r in model.relations]}", name)
    target = space.table(relation.target).model
    if relation.kind == "to":
        fk = foreign_key(model, relation.target, relation.alias)
        local, remote, many = fk.fields, fk.target_fields, False
    elif relation.kind == "from":
        fk = foreign_key(target, model.name, relation.alias)
        local, remote, many = fk.target_fields, fk.fields, relation.many
    else:
        return _attach_via(parents, relation, spec, model, target, space)
    rows, controls, chosen = _target(space, relation, spec, remote)
    keys = [F.col(f"`{r}`") for r in remote]
    names = [f"__k{i}" for i in range(len(keys))]
    if relation.kind == "to" and set(remote) == set(target.pk) and not controls.get("$skip"):
        right = rows.select(*[k.alias(n) for k, n in zip(keys, names)], _value(rows, chosen).alias("__value"))
    else:
        right = _gathered(rows, keys, names, _value(rows, chosen), controls, target, many)
    return _joined(parents, right, local, names, name, many)


def _joined(parents: DataFrame, right: DataFrame, local: tuple[str, ...], names: list[str], name: str, many: bool) -> DataFrame:
    on = None
    for left_name, right_name in zip(local, names):
        same = parents[f"`{left_name}`"] == right[right_name]
        on = same if on is None else on & same
    out = parents.drop(name) if name in parents.columns else parents
    joined = out.join(right, on, "left").drop(*names)
    value = F.coalesce(F.col("__value"), F.array().cast(joined.schema["__value"].dataType)) if many else F.col("__value")
    return joined.withColumn(name, value).drop("__value")


def _attach_via(parents: DataFrame, relation: Relation, spec: Any, model: Model, target: Model, space: "Space") -> DataFrame:
    """Many to many: junction rows that dangle are dropped, duplicates repeat the target."""
    junction = space.table(relation.junction)
    own = foreign_key(junction.model, model.name, relation.alias)
    other = foreign_key(junction.model, relation.target, None)
    rows, controls, chosen = _target(space, relation, spec, other.target_fields)
    names, links = [f"__k{i}" for i in range(len(own.fields))], [f"__l{i}" for i in range(len(other.fields))]
    pairs = junction.frame().select(*[F.col(f"`{f}`").alias(n) for f, n in zip(own.fields, names)], *[F.col(f"`{f}`").alias(n) for f, n in zip(other.fields, links)])
    on = None
    for field, link in zip(other.target_fields, links):
        same = rows[f"`{field}`"] == pairs[link]
        on = same if on is None else on & same
    value = _value(rows, chosen)
    joined = rows.join(pairs, on).drop(*links)
    right = _gathered(joined, [F.col(n) for n in names], names, value, controls, target, True)
    return _joined(parents, right, own.target_fields, names, relation.name, True)


def with_relations(parents: DataFrame, specs: list, model: Model, space: "Space") -> DataFrame:
    for spec in specs or []:
        parents = attach(parents, spec, model, space)
    return parents


def join_keys(specs: list, model: Model, space: "Space") -> tuple[str, ...]:
    """Parent columns that the relations join on; a projection keeps them."""
    out: list[str] = []
    for spec in specs or []:
        relation = model.relation(spec if isinstance(spec, str) else spec["name"])
        if relation is None:
            continue
        if relation.kind == "to":
            out += foreign_key(model, relation.target, relation.alias).fields
        else:
            owner = space.table(relation.target if relation.kind == "from" else relation.junction).model
            out += foreign_key(owner, model.name, relation.alias).target_fields
    return tuple(dict.fromkeys(out))
