"""Reports, edits and commands: flat projections, overlays, and folds of event tables (what MERGE would do)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geodesy as E
from ..functions import geometry as G
from .status import placement_method

#: Labels of placement methods, fields that may be edited, review states.
METHOD_LABELS = {
    "manual": "Placed by reviewer",
    "control": "Fitted to printed survey control points",
    "apn": "Fitted to county parcel records (APN)",
    "aliquot": "Fitted to PLSS aliquot part (BLM)",
    "surveyed_corner": "Bound to a printed parcel-corner coordinate",
    "apn_approx": "Oriented by county parcel records (position approximate)",
    "anchor": "Document-level anchor only (approximate)",
}
EDITABLE_PROJECT = ("title", "client", "project_ref", "prepared_by", "source_type", "county", "state")
EDITABLE_PARCEL = ("label", "apn", "review_status", "notes")
REVIEW_STATUSES = ("pending", "approved", "rejected", "needs_field_check")


def build_report(parcels: DataFrame) -> DataFrame:
    """Confirmed parcels with a ring of four points or more: system, area, perimeter, centre, method, checks.

    ``parcels``: document_id, id, ring (lon/lat, x and y) and the flags of the status trees.
    """
    p = parcels.filter(F.col("human_confirmed") & (F.size("ring") >= 4))
    p = p.withColumn("centre", G.vertex_mean(F.col("ring"))).withColumn("epsg", G.utm_epsg(F.col("centre.x"), F.col("centre.y")))
    p = p.withColumn("m", E.projected_measures("ring", "epsg")).withColumn("method", placement_method(F.struct(*[c for c in p.columns])))
    labels = F.create_map(*(F.lit(x) for kv in METHOD_LABELS.items() for x in kv))
    return p.select(*parcels.columns, "centre", "epsg", F.round("m.area_sqft", 1).alias("area_sqft"), F.round(F.col("m.area_sqft") / 43_560, 4).alias("area_acres"), F.round("m.perimeter_ft", 2).alias("perimeter_ft"), F.col("method.method").alias("placement_method"), labels[F.col("method.method")].alias("placement_label"), F.col("method.confirmed").alias("location_confirmed"))


def summarise(report: DataFrame) -> DataFrame:
    return report.groupBy("document_id").agg(F.count(F.lit(1)).alias("parcels"), F.count_if("location_confirmed").alias("confirmed"), F.round(F.sum("area_sqft"), 1).alias("total_sqft"), F.count_if(F.col("review_status") == "approved").alias("approved"))


def bounds(report: DataFrame) -> DataFrame:
    at = report.select("document_id", F.explode("ring").alias("p"))
    return at.groupBy("document_id").agg(F.min("p.x").alias("west"), F.min("p.y").alias("south"), F.max("p.x").alias("east"), F.max("p.y").alias("north"))


def text_field(c: Column, most: int = 254) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, most)


def attribute_rows(report: DataFrame) -> DataFrame:
    """One flat record a parcel, field names of ten characters at most, texts cut at 254."""
    has = lambda c: F.col(c) if c in report.columns else F.lit(None)
    blank = lambda c: text_field(has(c).cast("string"))
    return report.select(
        F.col("id").alias("ParcelID"), F.col("label").alias("Label"), blank("apn").alias("APN"), blank("parent_apn").alias("ParentAPN"), blank("county").alias("County"), blank("state").alias("State"),
        has("stated_area_sqft").cast("double").alias("StatedSF"), F.col("area_sqft").alias("CalcSF"), F.col("area_acres").alias("CalcAcres"), has("area_diff_pct").cast("double").alias("AreaDiffPc"), F.col("perimeter_ft").alias("PerimFt"), has("closure_error_ft").cast("double").alias("ClosureFt"),
        blank("source_document").alias("SrcID"), has("page_number").cast("int").alias("SrcPage"), blank("source_type").alias("SrcType"), F.lit("digitised + reviewer confirmed").alias("AutoMeth"), F.col("placement_label").alias("PlaceMeth"),
        F.when(F.col("location_confirmed"), "confirmed").otherwise("approximate").alias("LocConf"), F.coalesce(has("review_status").cast("string"), F.lit("pending")).alias("Review"), F.substring(has("generated_at").cast("string"), 1, 10).alias("UpdDate"), blank("notes").alias("Notes"),
    )


def vertex_rows(report: DataFrame) -> DataFrame:
    return report.select("document_id", "id", F.posexplode("ring").alias("seq", "p")).select("document_id", "id", (F.col("seq") + 1).alias("vertex"), F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))


def call_rows(parcels: DataFrame) -> DataFrame:
    """Numbered courses of each parcel (calls array): lines, then curves."""
    c = parcels.select("document_id", "id", F.posexplode("calls").alias("pos", "c")).select("document_id", "id", "pos", "c.*")
    kind = F.when(F.col("call_type") == "curve", 1).otherwise(0)
    return c.withColumn("course", F.row_number().over(Window.partitionBy("document_id", "id").orderBy(kind, "pos"))).drop("pos")


def valid_edits(edits: DataFrame) -> DataFrame:
    """Edits (document_id, scope, id, field, value, editor, at) of editable fields; review states must be known."""
    project = (F.col("scope") == "project") & F.col("field").isin(*EDITABLE_PROJECT)
    parcel = (F.col("scope") == "parcel") & F.col("field").isin(*EDITABLE_PARCEL) & ((F.col("field") != "review_status") | F.col("value").isin(*REVIEW_STATUSES))
    return edits.filter(project | parcel)


def edit_log(edits: DataFrame) -> DataFrame:
    """Valid edits that change something, in order: an edit equal to the last value of its field is not logged."""
    w = Window.partitionBy("document_id", "scope", "id", "field").orderBy("at", "value")
    e = valid_edits(edits).withColumns({"_old": F.lag("value").over(w), "_first": F.row_number().over(w) == 1})
    return e.filter((F.col("_first") & F.col("value").isNotNull()) | (~F.col("_first") & ~F.col("value").eqNullSafe(F.col("_old")))).drop("_old", "_first")


def latest_edits(edits: DataFrame, keys: list[str]) -> DataFrame:
    """Last value of each field, one row a key with a map of fields."""
    last = valid_edits(edits).groupBy(*keys, "field").agg(F.max_by(F.struct("value"), F.struct("at", "value")).alias("v"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("field", F.col("v.value").alias("value")))).alias("edits"))


def overlay(report: DataFrame, edits: DataFrame, fields: tuple[str, ...] = EDITABLE_PARCEL) -> DataFrame:
    """``report`` with edited fields in place of its own; an edit to null counts."""
    keys = ["document_id", "id"]
    e = latest_edits(edits.filter("scope = 'parcel'"), keys)
    out = report.join(e, keys, "left")
    return out.withColumns({f: F.when(F.coalesce(F.map_contains_key("edits", f), F.lit(False)), F.try_element_at("edits", F.lit(f))).otherwise(F.col(f)) for f in fields if f in report.columns}).drop("edits")


# commands as events

def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key under a total order; ``order`` ascends."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def current_versions(results: DataFrame, confirmations: DataFrame, keys: list[str]) -> DataFrame:
    """Results of the latest confirmation only: one that was overtaken is discarded."""
    now = latest(confirmations, keys, ["ts", "confirmation_id"]).select(*keys, "confirmation_id")
    return results.join(now, [*keys, "confirmation_id"], "left_semi")


def tombstoned(entities: DataFrame, deletions: DataFrame, keys: list[str]) -> DataFrame:
    """Entities without the deleted ones; confirmed ones cannot be deleted."""
    gone = deletions.join(entities.filter("human_confirmed"), keys, "left_anti")
    return entities.join(gone, keys, "left_anti")


def proposals(events: DataFrame) -> DataFrame:
    """State of each proposal by its first decision: later ones find it decided."""
    first = events.filter("action in ('apply', 'discard')").groupBy("document_id", "proposal_id").agg(F.min_by("action", F.struct("ts", "action")).alias("decision"))
    made = events.filter("action = 'propose'").select("document_id", "proposal_id").distinct()
    return made.join(first, ["document_id", "proposal_id"], "left").withColumn("status", F.when(F.col("decision") == "apply", "applied").when(F.col("decision") == "discard", "discarded").otherwise("pending")).drop("decision")


def checked_proposals(moves: DataFrame, checks: DataFrame, match_m: float = 3.0) -> DataFrame:
    """Proposed moves (document_id, page_number, east_m, north_m) under 20 km, each with the latest check of the same move (seq), if its fit is strong."""
    near = (F.abs(F.col("c.east_m") - F.col("m.east_m")) <= match_m) & (F.abs(F.col("c.north_m") - F.col("m.north_m")) <= match_m)
    j = moves.alias("m").join(checks.alias("c"), (F.col("m.document_id") == F.col("c.document_id")) & (F.col("m.page_number") == F.col("c.page_number")) & near)
    strong = F.coalesce(F.col("corroborated"), F.lit(False)) | ((F.col("hugging_pct") >= 50) & (F.col("overlap_pct") <= 3))
    last = j.filter(F.hypot("m.east_m", "m.north_m") < 20_000).groupBy("m.document_id", "m.page_number", "m.east_m", "m.north_m").agg(F.max_by(strong, "c.seq").alias("strong"))
    return last


def run_summary(parcels: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, valid rate, mean precision and area-match rate of a run's parcels; rates are null without a denominator."""
    return parcels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("parcels"),
        F.count_if("valid").alias("valid"),
        F.try_divide(F.count_if("valid").cast("double"), F.count(F.lit(1)).cast("double")).alias("valid_rate"),
        F.avg("precision_ratio").alias("mean_precision"),
        F.try_divide(F.count_if("area_matches_stated").cast("double"), F.count("area_matches_stated").cast("double")).alias("area_match_rate"),
    )


def pooled(parcels: DataFrame, key: str, measures: dict[str, Column]) -> DataFrame:
    """Per-key and overall totals, the overall row having a null key."""
    return parcels.rollup(key).agg(*(m.alias(n) for n, m in measures.items()), F.grouping(key).cast("int").alias("is_total"))
