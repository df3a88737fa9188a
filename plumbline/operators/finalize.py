"""A finished pipeline's result meets what users did meanwhile.

Three states of a table are merged by key and field: the one the pipeline started from (``base``), the stored one with the edits made
since (``ours``), and the pipeline's (``theirs``).  A field that one side changed takes that side's value; if both changed it and
differ, its owner's value stays and the other is refused.  Rows that only one side added stay; a row that one side took away goes unless
the other changed it.  Edits themselves are reduced by field and version first, so the order in which they arrive decides
nothing; a verification's result only counts for the confirmation it was made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFUSED = "array<struct<field:string,kept:string,refused:string,reason:string>>"


def latest_edits(edits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, value, version: the highest version of each field; of equal versions the greater editor, then value (nulls last).

    ``edits``: keys, field, value, version, editor.
    """
    order = F.struct("version", F.col("editor").isNotNull().alias("a"), "editor", F.col("value").isNotNull().alias("b"), "value")
    return edits.filter("field is not null and version is not null").groupBy(*keys, "field").agg(F.max(order).alias("e")).select(*keys, "field", "e.value", "e.version")


def edited(state: DataFrame, edits: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``state`` (keys, ``fields`` and others) with the latest edit of each field; edits of rows or fields it lacks change nothing."""
    wide = latest_edits(edits, keys).filter(F.col("field").isin(fields)).groupBy(*keys).agg(*(F.max(F.when(F.col("field") == f, F.struct("value"))).alias(f"_{f}") for f in fields))
    joined = state.join(wide, keys, "left")
    kinds = {x.name: x.dataType for x in state.schema.fields}
    # an edit to null is one, too: the struct tells it from no edit
    return joined.select(*(F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.value").cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in state.columns))


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str], ours_own: list[str], theirs_own: list[str]) -> DataFrame:
    """keys, all fields, ``origin`` and ``refused`` of the merged rows.

    ``ours_own`` are fields in which the stored state wins a conflict, ``theirs_own`` those in which the pipeline does.  ``origin`` is
    both, ours or theirs, whoever has the row at the end.  Keys are unique in each table.
    """
    fields = [*ours_own, *theirs_own]
    side = lambda df, p: df.select(*keys, F.struct(*fields).alias(p))
    j = side(base, "b").join(side(ours, "o"), keys, "full_outer").join(side(theirs, "t"), keys, "full_outer")
    differs = lambda x, y: ~F.col(x).eqNullSafe(F.col(y))
    added_twice = F.col("b").isNull() & F.col("o").isNotNull() & F.col("t").isNotNull()
    in_base, here, there = F.col("b").isNotNull(), F.col("o").isNotNull(), F.col("t").isNotNull()
    kept = (here & there) | (here & ~there & (~in_base | differs("b", "o"))) | (there & ~here & (~in_base | differs("b", "t")))

    def value(f: str) -> Column:
        changed_o, changed_t = differs(f"b.{f}", f"o.{f}") | added_twice, differs(f"b.{f}", f"t.{f}") | added_twice
        wins = F.col(f"o.{f}") if f in ours_own else F.col(f"t.{f}")
        both = F.when(changed_o & changed_t, wins).when(changed_o, F.col(f"o.{f}")).otherwise(F.col(f"t.{f}"))
        return F.when(~there, F.col(f"o.{f}")).when(~here, F.col(f"t.{f}")).otherwise(both).alias(f)

    def refusal(f: str) -> Column:
        clash = here & there & differs(f"o.{f}", f"t.{f}") & ((differs(f"b.{f}", f"o.{f}") & differs(f"b.{f}", f"t.{f}")) | added_twice)
        kept_, lost = (f"o.{f}", f"t.{f}") if f in ours_own else (f"t.{f}", f"o.{f}")
        return F.when(clash, F.struct(F.lit(f).alias("field"), F.col(kept_).cast("string").alias("kept"), F.col(lost).cast("string").alias("refused"), F.lit("changed on both sides").alias("reason")))

    gone = F.when(in_base & (here != there), F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("kept"), F.lit(None).cast("string").alias("refused"), F.when(here, F.lit("changed by a user, gone from the new result")).otherwise(F.lit("taken away by a user, changed in the new result")).alias("reason")))
    refused = F.filter(F.array(*map(refusal, fields), gone), lambda x: x.isNotNull()).cast(REFUSED)
    origin = F.when(here & there, "both").when(here, "ours").otherwise("theirs")
    return j.filter(kept).select(*keys, *map(value, fields), origin.alias("origin"), refused.alias("refused"))


def verified(state: DataFrame, results: DataFrame, keys: list[str], derived: list[str], confirmation: str = "confirmation_id") -> tuple[DataFrame, DataFrame]:
    """``state`` with the ``derived`` fields of verification results, and the results that were refused with a reason.

    A result (keys, ``confirmation``, version, ``derived``) counts if its confirmation is still the row's; of several the highest version.
    """
    best = results.groupBy(*keys, confirmation).agg(F.max(F.struct("version", *derived)).alias("_r"))
    own = best.withColumnRenamed(confirmation, "_of")
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys] + [F.col(f"s.{confirmation}") == F.col("r._of")]
    joined = state.alias("s").join(own.alias("r"), on, "left")
    out = joined.select(*(F.when(F.col("r._r").isNotNull(), F.col(f"r._r.{c}")).otherwise(F.col(f"s.{c}")).alias(c) if c in derived else F.col(f"s.{c}").alias(c) for c in state.columns))
    current = state.select(*keys, F.col(confirmation).alias("_now"), F.lit(True).alias("_row"))
    held = results.join(current, keys, "left").join(best.select(*keys, confirmation, F.col("_r.version").alias("_best")), [*keys, confirmation], "left")
    reason = F.when(F.col("_row").isNull(), "no such row").when(F.col("_now").isNull() | F.col(confirmation).isNull() | (F.col("_now") != F.col(confirmation)), "confirmed anew meanwhile").when(F.col("version") < F.col("_best"), "replaced by a later result")
    return out, held.withColumn("reason", reason).filter("reason is not null").select(*keys, confirmation, "version", "reason")
