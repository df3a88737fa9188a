"""Two runs held against each other: stored stages are run again over their stored inputs, and what differs is named.

A stage is a pure function of tables.  It is run over what the stored run gave it, not over what the stage before gives now, so that
a change shows in the stage that made it.  Rows are compared by key: first by a digest of all columns, which moves a
few bytes a row, and only rows whose digests differ are compared column by column, numbers with a tolerance.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

DIFFERENCE = "kind string, columns array<string>"


@dataclass(frozen=True)
class Stage:
    """``run`` makes table ``name`` of the tables ``reads``; its rows are told apart by ``keys``."""

    name: str
    reads: tuple[str, ...]
    run: Callable[..., DataFrame]
    keys: tuple[str, ...]
    tolerances: dict[str, float] = field(default_factory=dict)


def _digest(df: DataFrame, columns: list[str]) -> Column:
    """Of all columns; -0.0 is 0.0, and maps count as arrays."""
    plain = [F.to_json(F.array_sort(F.map_entries(c))) if df.schema[c].dataType.typeName() == "map" else F.col(c) + F.lit(0.0) if isinstance(df.schema[c].dataType, FractionalType) else F.col(c) for c in columns]
    return F.xxhash64(*plain)


def difference(before: DataFrame, after: DataFrame, keys: list[str], tolerances: dict[str, float] | None = None) -> DataFrame:
    """keys, kind (changed, missing, added) and the names of the columns that changed; rows that agree are left out.

    ``tolerances``: largest absolute difference of numeric columns that counts as none.  Columns that only one side has are changes of every
    row.  Keys are unique on either side; null keys are keys.
    """
    tolerances = tolerances or {}
    shared = [c for c in before.columns if c in after.columns and c not in keys]
    extra = sorted(set(before.columns) ^ set(after.columns))
    on = lambda a, b: reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))
    digests = lambda df: df.select(*keys, _digest(df, shared).alias("digest"))
    met = digests(before).alias("x").join(digests(after).alias("y"), on("x", "y"), "full_outer")
    there, here = F.col("x.digest").isNotNull(), F.col("y.digest").isNotNull()
    key = [F.coalesce(F.col(f"x.{k}"), F.col(f"y.{k}")).alias(k) for k in keys]
    odd = met.select(*key, F.when(~here, "missing").when(~there, "added").when((F.col("x.digest") != F.col("y.digest")) | F.lit(bool(extra)), "changed").alias("kind")).filter("kind is not null")
    wide = odd.filter("kind = 'changed'").alias("o").join(before.alias("x"), on("o", "x")).join(after.alias("y"), on("o", "y"))

    def differs(c: str) -> Column:
        x, y = F.col(f"x.{c}"), F.col(f"y.{c}")
        if c in tolerances:
            near = F.abs(x - y) <= tolerances[c]
            return ~F.coalesce(near, F.lit(False)) & ~x.eqNullSafe(y)
        if before.schema[c].dataType.typeName() == "map":
            return ~F.to_json(F.array_sort(F.map_entries(x))).eqNullSafe(F.to_json(F.array_sort(F.map_entries(y))))
        return ~x.eqNullSafe(y)

    names = F.array_compact(F.array(*(F.when(differs(c), F.lit(c)) for c in shared), *(F.lit(c) for c in extra)).cast("array<string>"))
    changed = wide.select(*(F.col(f"o.{k}").alias(k) for k in keys), F.lit("changed").alias("kind"), names.alias("columns")).filter(F.size("columns") > 0)
    rest = odd.filter("kind <> 'changed'").select(*keys, "kind", F.array().cast("array<string>").alias("columns"))
    return changed.unionByName(rest)


def replay(stored: dict[str, DataFrame], stages: list[Stage], document: str = "document_id") -> DataFrame:
    """stage, place (of the stage), ``document``, row (its key as JSON), kind and columns of everything that differs from the stored run."""
    found = None
    for place, stage in enumerate(stages):
        now = stage.run(*(stored[t] for t in stage.reads))
        one = difference(stored[stage.name], now, list(stage.keys), stage.tolerances)
        one = one.select(F.lit(stage.name).alias("stage"), F.lit(place).alias("place"), document, F.to_json(F.struct(*stage.keys)).alias("row"), "kind", "columns")
        found = one if found is None else found.unionByName(one)
    return found


def first_difference(differences: DataFrame, document: str = "document_id") -> DataFrame:
    """For each document the first stage that differs, how many of its rows do, and the columns they differ in."""
    first = differences.groupBy(document).agg(F.min("place").alias("place"))
    rows = differences.join(first, [document, "place"]).groupBy(document, "place", "stage")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("columns")))).alias("columns")).drop("place")
