"""Nested writes: a payload with related objects becomes ordered plans, one for each table."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from .relations import foreign_key
from .writes import insert, replace_rows, update_rows

if TYPE_CHECKING:
    from ..sources.space import Space


def plan_insert(space: "Space", name: str, payloads: list[dict], max_depth: int | None = None) -> list[tuple[str, list[dict]]]:
    """The rows to insert by table, in order: what rows refer to, the rows, what refers to them, junction rows.

    Keys have to be in the payloads, as rows are inserted in bulk.  Composite keys
    are linked like single ones.
    """
    model = space.table(name).model
    limit = model.depth_limit if max_depth is None else max_depth
    out: list[tuple[str, list[dict]]] = []

    def walk(table: str, rows: list[dict], depth: int) -> None:
        own = space.table(table).model
        names = {r.name: r for r in own.relations}
        before: list[tuple[str, list[dict]]] = []
        after: list[tuple[str, list[dict]]] = []
        plain = []
        for payload in rows:
            row = {k: v for k, v in payload.items() if k not in names}
            for key, relation in names.items():
                if key not in payload:
                    continue
                if depth >= limit:
                    raise QueryError("DEPTH_EXCEEDED", f"nested deeper than {limit}", key)
                value = payload[key]
                if value is None:
                    raise QueryError("INVALID_QUERY", "a relation can't be null", key)
                items = value if isinstance(value, list) else [value]
                if relation.kind == "to":
                    fk = foreign_key(own, relation.target, relation.alias)
                    row.update({f: items[0].get(t) for f, t in zip(fk.fields, fk.target_fields)})
                    before.append((relation.target, items))
                elif relation.kind == "from":
                    fk = foreign_key(space.table(relation.target).model, table, relation.alias)
                    after.append((relation.target, [{**x, **{f: row.get(t) for f, t in zip(fk.fields, fk.target_fields)}} for x in items]))
                else:
                    junction = space.table(relation.junction).model
                    mine, theirs = foreign_key(junction, table, relation.alias), foreign_key(junction, relation.target, None)
                    pk = space.table(relation.target).model.pk
                    fresh = [x for x in items if set(x) - set(pk)]
                    if fresh:
                        before.append((relation.target, fresh))
                    after.append((relation.junction, [{**{f: row.get(t) for f, t in zip(mine.fields, mine.target_fields)}, **{f: x.get(t) for f, t in zip(theirs.fields, theirs.target_fields)}} for x in items]))
            plain.append(row)
        for target, items in before:
            walk(target, items, depth + 1)
        out.append((table, plain))
        for target, items in after:
            walk(target, items, depth + 1)

    walk(name, payloads, 0)
    merged: list[tuple[str, list[dict]]] = []
    for table, rows in out:
        if merged and merged[-1][0] == table:
            merged[-1][1].extend(rows)
        else:
            merged.append((table, list(rows)))
    return merged


def replace_children(space: "Space", name: str, relation_name: str, parents: DataFrame, new: DataFrame) -> dict[str, DataFrame]:
    """``$replace`` of a relation of the given parents; returns the tables that change, as they are after it.

    One to many: children of these parents that aren't in ``new`` go, the others
    are replaced or come.  Many to many: the parents' junction rows are rebuilt;
    ``new`` then has the columns of the junction.
    """
    model = space.table(name).model
    relation = model.relation(relation_name)
    if relation is None or relation.kind == "to":
        raise QueryError("INVALID_QUERY", "not a relation to many", relation_name)
    owner = space.table(relation.target if relation.kind == "from" else relation.junction)
    fk = foreign_key(owner.model, name, relation.alias)
    rows = owner.frame()
    mine = parents.select(*[F.col(f"`{t}`").alias(f) for f, t in zip(fk.fields, fk.target_fields)]).distinct()
    kept = rows.join(mine, list(fk.fields), "left_anti")
    strangers = new.join(mine, list(fk.fields), "left_anti")
    if strangers.limit(1).count():
        raise QueryError("INVALID_QUERY", "a row belongs to another parent", relation_name)
    moved = kept.join(new.select(*owner.model.pk), list(owner.model.pk), "left_anti") if relation.kind == "from" and owner.model.pk else kept
    return {owner.model.name: moved.select(*rows.columns).unionByName(new.select(*rows.columns))}


def patch_children(space: "Space", name: str, relation_name: str, ops: dict[str, Any]) -> dict[str, DataFrame]:
    """``$insert``, ``$upsert``, ``$update`` and ``$remove`` of a one-to-many relation, in the order of array patches.

    Each operand is a table of child rows (for ``$remove``, of their keys).
    """
    model = space.table(name).model
    relation = model.relation(relation_name)
    if relation is None or relation.kind != "from":
        raise QueryError("INVALID_QUERY", "not a one-to-many relation", relation_name)
    child = space.table(relation.target)
    rows, keys = child.frame(), list(child.model.pk)
    for op in ops:
        if op not in ("$insert", "$upsert", "$update", "$remove"):
            raise QueryError("INVALID_QUERY", "unknown operation", op)
    if "$remove" in ops:
        rows = rows.join(ops["$remove"].select(*keys), keys, "left_anti").select(*rows.columns)
    if "$update" in ops:
        rows = update_rows(rows, ops["$update"], child.model)
    if "$upsert" in ops:
        fresh = ops["$upsert"].join(rows.select(*keys), keys, "left_anti")
        rows = insert(replace_rows(rows, ops["$upsert"], child.model), fresh, child.model)
    if "$insert" in ops:
        rows = insert(rows, ops["$insert"], child.model)
    return {child.model.name: rows}
