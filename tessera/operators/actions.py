"""Row actions: which are open for a row, and the rows that pass an action's gate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError


@dataclass(frozen=True)
class Action:
    """``disabled`` maps field columns to a boolean column; it needs its fields declared."""

    name: str
    level: str = "row"
    required: tuple[str, ...] = ()
    disabled: Callable[[dict[str, Column]], Column] | None = None
    mode: str = "reject"

    def __post_init__(self):
        if self.disabled is not None and (not self.required or self.level == "table"):
            raise QueryError("INVALID_QUERY", "a gate needs fields and rows", self.name)

    def off(self) -> Column:
        return F.lit(False) if self.disabled is None else F.coalesce(self.disabled({f: F.col(f"`{f}`") for f in self.required}), F.lit(False))


def augment(df: DataFrame, actions: list[Action], extra: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``$actions``, the names of the enabled row actions in order; ``extra`` fields are taken off again."""
    distinct = list({a.name: a for a in actions if a.level != "table"}.values())
    names = F.array(*[F.when(~a.off(), F.lit(a.name)) for a in distinct]) if distinct else F.array().cast("array<string>")
    return df.withColumn("$actions", F.filter(names, lambda x: x.isNotNull())).drop(*extra)


def fetch(df: DataFrame, ids: list[Any], key: str) -> DataFrame:
    """The rows with the given ids in the order asked for, once each; a missing id is a row of nulls (``__found`` false)."""
    asked = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(dict.fromkeys(ids))], ["__at", "__id"])
    rows = df.withColumn("__found", F.lit(True))
    return asked.join(rows, asked["__id"] == rows[f"`{key}`"], "left").withColumn("__found", F.coalesce("__found", F.lit(False))).orderBy("__at")


def gate(rows: DataFrame, action: Action) -> DataFrame:
    """Rows that pass.  A missing row fails; ``reject`` fails the call if any row fails, ``skip`` only if all do."""
    if "__found" not in rows.columns:
        rows = rows.withColumn("__found", F.lit(True))
    marked = rows.withColumn("__ok", F.col("__found") & ~action.off())
    counts = marked.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("__ok"), 1)).alias("ok")).first()
    if counts["n"] and (counts["ok"] == 0 or action.mode == "reject" and counts["ok"] < counts["n"]):
        raise QueryError("CONFLICT", f"{counts['n'] - counts['ok']} rows don't allow it", action.name)
    return marked.where("__ok").drop("__ok", "__found")
