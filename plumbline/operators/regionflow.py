"""The passes over a region's extracted parcels, composed: repair, curves, walk, validate, borrow, shared edges, georeference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geodesy as E
from ..functions import text as T
from . import cogo, search

REGION = ["document_id", "page_number", "region_index"]
KEY = [*REGION, "parcel_index"]
_CALLS = "array<struct<bearing:string,distance:string>>"


def _explode(parcels: DataFrame) -> DataFrame:
    return parcels.select(*KEY, F.posexplode("calls").alias("seq", "c")).select(*KEY, "seq", "c.bearing", "c.distance")


def _walked(parcels: DataFrame, curves: DataFrame | None) -> DataFrame:
    lines = _explode(parcels)
    calls = cogo.merge_curve_calls(lines, curves, KEY) if curves is not None else lines
    walks = cogo.walk_traverse(calls, KEY)
    return cogo.validate(parcels.join(walks, KEY))


def walk_region_parcels(parcels: DataFrame, curves: DataFrame | None = None) -> DataFrame:
    """``parcels``: KEY, label, calls, alternates, stated_area_acres, region_text, anchor_lat, anchor_lon -> walks, checks and rings.

    One parcel alone takes the acreage of the region's only CONTAINING clause.  Calls are repaired among siblings,
    curves join after that, invalid parcels may borrow one line of a neighbour, combined tracts are flagged, and
    valid walks are placed at their anchor.
    """
    w = Window.partitionBy(*REGION)
    alone = F.when(F.count(F.lit(1)).over(w) == 1, T.containing_area_sqft("region_text"))
    p = parcels.withColumn("stated_area_sqft", F.coalesce(alone, T.acres_to_sqft("stated_area_acres")))
    others = F.collect_list(F.struct("parcel_index", "stated_area_sqft")).over(w)
    p = p.withColumn("sibling_sqfts", F.transform(F.filter(others, lambda s: (s["parcel_index"] != F.col("parcel_index")) & s["stated_area_sqft"].isNotNull()), lambda s: s["stated_area_sqft"]))
    p = p.withColumn("stated_area_acres", F.coalesce((F.col("stated_area_sqft") / T.SQFT_PER_ACRE).cast("string"), "stated_area_acres"))
    fixed = search.repair_frame(p, KEY)
    base = p.select(*KEY, "label", "stated_area_acres", "stated_area_sqft", "region_text", "anchor_lat", "anchor_lon")
    first = _walked(base.drop("stated_area_sqft").join(fixed, KEY), curves).select(*KEY, "valid")
    tried = base.join(fixed, KEY).join(first, KEY)
    lent = search.borrow_frame(tried.select(*KEY, "label", "calls", "stated_area_sqft", "valid"), REGION)
    again = base.drop("stated_area_sqft").join(lent, KEY).join(fixed.select(*KEY, "notes"), KEY)
    again = again.withColumn("notes", F.when(F.col("note").isNotNull(), F.concat("notes", F.array("note"))).otherwise(F.col("notes"))).drop("note")
    done = cogo.combined_tract(_walked(again, curves), REGION)
    return done.withColumn("ring_wgs84", F.when(F.col("valid"), E.local_ring_to_lonlat("points", "anchor_lon", "anchor_lat")))


def recompute(parcels: DataFrame, auto_fix: bool = False) -> DataFrame:
    """Edited calls walked as they are given, or assembled first."""
    p = parcels.withColumn("stated_area_sqft", T.acres_to_sqft("stated_area_acres"))
    if auto_fix:
        none = p.withColumns({"alternates": F.array().cast(_CALLS), "sibling_sqfts": F.array().cast("array<double>")})
        p = p.drop("calls").join(search.repair_frame(none, KEY), KEY)
    return _walked(p.drop("stated_area_sqft"), None)


def resolve_shared_edges(walks: DataFrame) -> DataFrame:
    """Points of each parcel moved onto the edge it shares with the region's first parcel; the others stay."""
    at = walks.select(*KEY, F.posexplode("points").alias("seq", "p"))
    w = Window.partitionBy(*KEY).orderBy("seq")
    edges = at.withColumn("q", F.lead("p").over(w)).filter("q is not null")
    dx, dy = F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y")
    edges = edges.select(*KEY, "seq", F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0)).alias("azimuth"), F.hypot(dx, dy).alias("length"))
    first = walks.groupBy(*REGION).agg(F.min("parcel_index").alias("parcel_a"))
    shared = cogo.shared_edges(edges, REGION, "parcel_index").join(first, [*REGION, "parcel_a"])
    head = walks.join(first, REGION).filter("parcel_index = parcel_a").select(*REGION, F.col("points").alias("base"))
    j = walks.join(shared.withColumnRenamed("parcel_b", "parcel_index"), KEY, "left").join(head, REGION, "left")
    at_ = lambda c, i: F.get(F.col(c), F.col(i))
    nxt = lambda c, i: F.get(F.col(c), F.col(i) + 1)
    moved = cogo.align_to_edge(F.col("points"), at_("base", "seq_a"), nxt("base", "seq_a"), at_("points", "seq_b"), nxt("points", "seq_b"))
    return j.withColumns({"aligned": F.col("seq_b").isNotNull(), "points": F.when(F.col("seq_b").isNotNull(), moved).otherwise(F.col("points"))}).drop("base", "seq_a", "seq_b", "score", "parcel_a")
