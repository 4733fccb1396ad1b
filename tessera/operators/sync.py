"""Schema sync: snapshots, differences, plans and their application to stored tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..model import Model
from ..sources.readers import physical

#: What a new required column holds in old rows if it has no default.
ZEROS = {"string": "", "boolean": False, "timestamp": 0}


def snapshot(model: Model) -> dict:
    """What of a model is stored: columns, keys, references and indexes."""
    return {
        "table": model.source,
        "columns": {f.column or f.name: {"type": f.spark_type().simpleString(), "optional": f.optional, "default": f.default, "default_fn": f.default_fn, "pk": f.pk, "collate": f.collate} for f in model.fields if not f.ignore},
        "fks": sorted([[*fk.fields], fk.target, [*fk.target_fields], fk.on_delete, fk.on_update] for fk in model.fks),
        "indexes": sorted([i.name, i.kind, list(i.fields)] for i in model.all_indexes),
    }


def schema_hash(value: Any) -> str:
    """FNV-1a (32 bits) of the canonical JSON text."""
    h = 0x811C9DC5
    for byte in json.dumps(value, sort_keys=True, default=str).encode():
        h = (h ^ byte) * 0x01000193 & 0xFFFFFFFF
    return f"{h:08x}"


@dataclass
class Diff:
    added: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    renamed: list[tuple[str, str]] = field(default_factory=list)
    retyped: list[tuple[str, str, str]] = field(default_factory=list)
    nullability: list[str] = field(default_factory=list)
    defaults: list[str] = field(default_factory=list)
    conflicts: list[str] = field(default_factory=list)

    def __bool__(self) -> bool:
        return any(vars(self).values())

    def rows(self) -> list[tuple[str, str, str]]:
        """(change, column, detail) of each difference."""
        out = [("added", c, "") for c in self.added] + [("removed", c, "") for c in self.removed] + [("renamed", a, b) for a, b in self.renamed]
        out += [("retyped", c, f"{a} -> {b}") for c, a, b in self.retyped] + [("nullability", c, "") for c in self.nullability]
        return out + [("default", c, "") for c in self.defaults] + [("conflict", c, "") for c in self.conflicts]


def column_diff(old: dict, new: dict, renames: dict[str, str] | None = None) -> Diff:
    """What leads from one snapshot's columns to another's; ``renames`` maps new names to old ones."""
    diff, before, after = Diff(), dict(old["columns"]), new["columns"]
    for name, former in (renames or {}).items():
        if former in before and name in before:
            diff.conflicts.append(name)
        elif former in before and name in after:
            diff.renamed.append((former, name))
            before[name] = before.pop(former)
    diff.added = [c for c in after if c not in before]
    diff.removed = [c for c in before if c not in after]
    for c in (c for c in after if c in before):
        a, b = before[c], after[c]
        if a["type"] != b["type"]:
            diff.retyped.append((c, a["type"], b["type"]))
        if a["optional"] != b["optional"]:
            diff.nullability.append(c)
        if (a["default"], a["default_fn"]) != (b["default"], b["default_fn"]):
            diff.defaults.append(c)
    return diff


def fk_diff(old: dict, new: dict) -> dict[str, list]:
    a, b = ({json.dumps(x): x for x in s["fks"]} for s in (old, new))
    return {"added": [b[k] for k in b if k not in a], "removed": [a[k] for k in a if k not in b]}


def index_diff(old: dict, new: dict) -> dict[str, list]:
    a, b = ({json.dumps(x): x for x in s["indexes"]} for s in (old, new))
    return {"added": [b[k] for k in b if k not in a], "removed": [a[k] for k in a if k not in b]}


def apply_diff(rows: DataFrame, diff: Diff, model: Model) -> DataFrame:
    """Stored rows under the new schema: renames, added columns with their default, casts, back-filled nulls."""
    for former, name in diff.renamed:
        rows = rows.withColumnRenamed(former, name)
    by_column = {f.column or f.name: f for f in model.fields}

    def fill(c: str):
        f = by_column[c]
        value = f.default
        if value is None and not f.optional:
            kind = f.spark_type()
            value = ZEROS.get(f.type, 0 if isinstance(kind, T.NumericType) else None)
        return F.lit(value).cast(f.spark_type())

    for c in diff.added:
        rows = rows.withColumn(c, fill(c))
    for c, _, _ in diff.retyped:
        rows = rows.withColumn(c, F.col(f"`{c}`").try_cast(by_column[c].spark_type()))
    for c in diff.nullability:
        if not by_column[c].optional:
            rows = rows.withColumn(c, F.coalesce(F.col(f"`{c}`"), fill(c)))
    return rows.drop(*diff.removed)


def plan(models: list[Model], stored: dict[str, dict], renames: dict[str, dict[str, str]] | None = None) -> list[dict]:
    """What a sync would do, table by table: nothing where the hashes agree."""
    out = []
    for m in models:
        new = snapshot(m)
        former = m.renamed_from if m.renamed_from in stored and m.source not in stored else m.source
        old = stored.get(former)
        if old is None:
            out.append({"table": m.source, "action": "create", "snapshot": new})
        elif schema_hash(old) != schema_hash(new):
            out.append({"table": m.source, "action": "alter", "from": former, "columns": column_diff(old, new, (renames or {}).get(m.source)), "fks": fk_diff(old, new), "indexes": index_diff(old, new), "snapshot": new})
    held = {m.source for m in models} | {m.renamed_from for m in models}
    return out + [{"table": t, "action": "untracked"} for t in stored if t not in held]


#: Milliseconds after which a lock that nobody renewed counts as left behind.
LOCK_TTL = 30_000


class Sync:
    """Applies models to the tables of a folder, once for each change, by one process at a time.

    Snapshots and table locations are kept as a small Parquet table beside the
    data.  A changed table is written anew beside the old one and the locations
    are switched last, so readers see the old or the new table.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._store = f"{self.root}/_sync"
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _path(self, path: str):
        at = self._hadoop.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def stored(self) -> tuple[dict[str, dict], dict[str, str]]:
        """Snapshots and locations by table."""
        at, fs = self._path(self._store)
        if not fs.exists(at):
            return {}, {}
        rows = self.spark.read.schema("name string, snapshot string, location string").parquet(self._store).collect()
        return {r["name"]: json.loads(r["snapshot"]) for r in rows}, {r["name"]: r["location"] for r in rows}

    def frame(self, model: Model) -> DataFrame:
        """A table as stored."""
        return self.spark.read.parquet(self.stored()[1][model.source])

    def plan(self, models: list[Model], renames: dict[str, dict[str, str]] | None = None) -> list[dict]:
        return plan(models, self.stored()[0], renames)

    def run(self, models: list[Model], renames: dict[str, dict[str, str]] | None = None) -> list[dict]:
        """Does what :meth:`plan` says; returns it.  Does nothing where all hashes agree."""
        steps = [s for s in self.plan(models, renames) if s["action"] != "untracked"]
        if not steps:
            return []
        at, fs = self._path(f"{self.root}/_lock")
        if fs.exists(at) and self.spark.sparkContext._jvm.System.currentTimeMillis() - fs.getFileStatus(at).getModificationTime() > LOCK_TTL:
            fs.delete(at, False)
        try:
            fs.create(at, False).close()
        except Exception as e:
            raise QueryError("CONFLICT", "another sync holds the lock", self.root) from e
        try:
            snapshots, locations = self.stored()
            by_table = {m.source: m for m in models}
            for step in steps:
                model, new = by_table[step["table"]], step["snapshot"]
                location = f"{self.root}/{step['table']}-{schema_hash(new)}"
                if step["action"] == "create":
                    rows = physical(self.spark.createDataFrame([], model.schema()), model)
                else:
                    if step["columns"].conflicts:
                        raise QueryError("CONFLICT", f"old and new name both exist: {step['columns'].conflicts}", model.source)
                    rows = apply_diff(self.spark.read.parquet(locations[step["from"]]), step["columns"], model)
                    if step["from"] != step["table"]:
                        snapshots.pop(step["from"], None)
                        locations.pop(step["from"], None)
                rows.write.mode("overwrite").parquet(location)
                snapshots[step["table"]], locations[step["table"]] = new, location
            table = [(n, json.dumps(s, default=str), locations[n]) for n, s in snapshots.items()]
            self.spark.createDataFrame(table, "name string, snapshot string, location string").coalesce(1).write.mode("overwrite").parquet(self._store)
        finally:
            fs.delete(at, False)
        return steps
