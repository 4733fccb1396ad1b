"""Referential integrity: foreign-key checks and the effects of deletes, as semi- and anti-joins."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..model import ForeignKey

if TYPE_CHECKING:
    from ..sources.space import Space

#: How many tables deep a delete may reach.
DEPTH = 100


def _on(left: DataFrame, right: DataFrame, left_fields: tuple[str, ...], right_fields: tuple[str, ...]):
    return reduce(lambda a, b: a & b, [left[f"`{x}`"] == right[f"`{y}`"] for x, y in zip(left_fields, right_fields)])


def missing_targets(rows: DataFrame, fk: ForeignKey, target: DataFrame) -> DataFrame:
    """Rows whose whole key is set and has no target, compared as a tuple."""
    present = [f for f in fk.fields if f in rows.columns]
    if len(present) < len(fk.fields):
        return rows.where(F.lit(False))
    known = reduce(lambda a, b: a & b, [F.col(f"`{f}`").isNotNull() for f in fk.fields])
    keys = target.select(*[F.col(f"`{f}`").alias(f"__t{i}") for i, f in enumerate(fk.target_fields)])
    rows = rows.where(known)
    return rows.join(keys, reduce(lambda a, b: a & b, [rows[f"`{f}`"] == keys[f"__t{i}"] for i, f in enumerate(fk.fields)]), "left_anti")


def check_foreign_keys(rows: DataFrame, space: "Space", name: str) -> DataFrame:
    """Every broken reference of the rows (constraint, values)."""
    model, found = space.table(name).model, []
    for fk in model.fks:
        bad = missing_targets(rows, fk, space.table(fk.target).frame())
        found.append(bad.select(F.lit(f"{name}({','.join(fk.fields)}) -> {fk.target}").alias("constraint"), F.to_json(F.struct(*[F.col(f"`{f}`") for f in fk.fields])).alias("values")))
    if not found:
        return rows.select(F.lit("").alias("constraint"), F.lit("").alias("values")).where(F.lit(False))
    return reduce(lambda a, b: a.unionByName(b), found)


def children(space: "Space", name: str) -> list[tuple[str, ForeignKey]]:
    """The tables that refer to a table, with their keys."""
    return [(t, fk) for t in space.table_names() for fk in space.table(t).model.fks if fk.target == name]


def delete(space: "Space", name: str, filter, *, frames: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables that a delete changes, as they are after it.

    Restrictions are checked first, for all children; then rows cascade, are set
    to null or to their default.  A row is deleted once, so cycles end: each
    step only follows rows that are not yet gone.
    """
    frames = dict(frames or {})
    frame = lambda t: frames.get(t, space.table(t).frame())
    start = space.table(name)
    from ..plans.filters import apply_filter

    doomed = apply_filter(frame(name), filter, start.null_model, start.collations())
    queue: list[tuple[str, DataFrame, int]] = [(name, doomed, 0)]
    while queue:
        table, gone, depth = queue.pop(0)
        if depth > DEPTH:
            raise QueryError("CASCADE_CYCLE", "the delete reaches too deep", table)
        for child, fk in children(space, table):
            if fk.on_delete == "restrict":
                rows = frame(child)
                if rows.join(gone, _on(rows, gone, fk.fields, fk.target_fields), "left_semi").limit(1).count():
                    raise QueryError("FK_VIOLATION", f"{child} refers to it", table)
        model = space.table(table).model
        keys = model.pk or tuple(gone.columns)
        kept = frame(table)
        frames[table] = kept.join(gone.select(*[F.col(f"`{k}`").alias(f"__g{i}") for i, k in enumerate(keys)]), reduce(lambda a, b: a & b, [kept[f"`{k}`"].eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate(keys)]), "left_anti")
        for child, fk in children(space, table):
            rows = frame(child)
            if fk.on_delete == "cascade":
                hit = rows.join(gone, _on(rows, gone, fk.fields, fk.target_fields), "left_semi")
                if hit.limit(1).count():
                    queue.append((child, hit, depth + 1))
            elif fk.on_delete in ("setNull", "setDefault"):
                mark = gone.select(*[F.col(f"`{k}`").alias(f"__g{i}") for i, k in enumerate(fk.target_fields)]).distinct().withColumn("__hit", F.lit(True))
                joined = rows.join(mark, reduce(lambda a, b: a & b, [rows[f"`{f}`"] == mark[f"__g{i}"] for i, f in enumerate(fk.fields)]), "left")
                child_model = space.table(child).model

                def put(c: str, fk=fk, child_model=child_model, joined=joined):
                    f = child_model.find(c)
                    value = F.lit(f.default if fk.on_delete == "setDefault" and f is not None else None).cast(joined.schema[c].dataType)
                    return F.when(F.col("__hit"), value).otherwise(F.col(f"`{c}`")).alias(c)

                frames[child] = joined.select(*[put(c) if c in fk.fields else F.col(f"`{c}`") for c in rows.columns])
    return frames
