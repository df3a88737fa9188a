"""From a confirmed outline to its place on the map: the steps of a confirmation, composed.

``outlines`` has a row a confirmed parcel: KEY, confirmation_id, vertices (pixels of the drawing's crop), region (class, bbox),
page_width, page_height, calls (the parcel's resolved calls), stated_area_sqft, anchor_lat and anchor_lon of the document and
override_lat, override_lon (or null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geodesy as E
from ..functions import geometry as G
from ..functions import text as T
from . import cogo, placement
from .cogo import AREA_TOLERANCE
from .regionflow import KEY, REGION

#: The margin of a parcel drawing's crop, and how much of the crop a display fit fills.
MARGIN_PX, MARGIN_SHARE, PAD = 40.0, 0.08, 0.85


def crop_box(region: Column, page_width: Column, page_height: Column, margin_px: float = MARGIN_PX, share: float = MARGIN_SHARE) -> Column:
    """(x, y, w, h) of a region's crop on its page: parcel drawings have a margin, what lies off the page is cut."""
    b, map_ = region["bbox"], region["class"] == "ParcelMap"
    margin = lambda n: F.when(map_, F.greatest(F.lit(margin_px), b[n] * share)).otherwise(0.0)
    x0, y0 = F.greatest(F.lit(0.0), b["x"] - margin("w")), F.greatest(F.lit(0.0), b["y"] - margin("h"))
    x1, y1 = F.least(page_width, b["x"] + b["w"] + margin("w")), F.least(page_height, b["y"] + b["h"] + margin("h"))
    return F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def anchor_of(override_lat: Column, override_lon: Column, lat: Column, lon: Column) -> Column:
    """A parcel's own anchor if it has both numbers, else the document's."""
    own = override_lat.isNotNull() & override_lon.isNotNull()
    return F.struct(F.when(own, override_lat).otherwise(lat).alias("lat"), F.when(own, override_lon).otherwise(lon).alias("lon"))


def _box(ring: Column) -> Column:
    axis = lambda a: F.transform(ring, lambda p: p[a])
    return F.struct(*(f(axis(a)).alias(f"{n}_{a}") for a in ("x", "y") for n, f in (("lo", F.array_min), ("hi", F.array_max))))


def _middle(box: Column) -> Column:
    return F.struct(((box["lo_x"] + box["hi_x"]) / 2).alias("x"), ((box["lo_y"] + box["hi_y"]) / 2).alias("y"))


def seeded_ring(vertices: Column, seed: Column, width: Column, height: Column) -> Column:
    """Crop pixels in the frame of the extracted walk ``seed`` (feet), by the display fit that showed it; null under three corners."""
    box = _box(seed)
    span = lambda a: F.coalesce(F.nullif(box[f"hi_{a}"] - box[f"lo_{a}"], F.lit(0.0)), F.lit(1.0))
    scale, mid = F.least(width * PAD / span("x"), height * PAD / span("y")), _middle(box)
    ring = F.transform(vertices, lambda p: F.struct((mid["x"] + (p["x"] - width / 2) / scale).alias("x"), (mid["y"] - (p["y"] - height / 2) / scale).alias("y")))
    return F.when(F.size(seed) >= 3, ring)


def prepared(outlines: DataFrame) -> DataFrame:
    """``outlines`` with page_ring, crop, seed (corners of the extracted walk), local_ring (or null), pivots and anchor."""
    calls = outlines.select(*KEY, F.posexplode("calls").alias("seq", "c")).select(*KEY, "seq", "c.bearing", "c.distance")
    walks = cogo.walk_traverse(calls, KEY).select(*KEY, F.slice("points", 1, F.size("points") - 1).alias("seed"))
    o = outlines.join(walks, KEY, "left").withColumn("crop", crop_box(F.col("region"), F.col("page_width"), F.col("page_height")))
    o = o.withColumn("seed", F.when(F.size("seed") >= 3, F.col("seed")))
    centre = F.struct((F.col("crop.x") + F.col("crop.w") / 2).alias("x"), (F.col("crop.y") + F.col("crop.h") / 2).alias("y"))
    origin = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return o.withColumns({
        "page_ring": G.translate_ring(F.col("vertices"), F.col("crop.x"), F.col("crop.y")),
        "local_ring": seeded_ring(F.col("vertices"), F.col("seed"), F.col("crop.w"), F.col("crop.h")),
        "page_pivot": centre,
        "local_pivot": F.coalesce(F.when(F.col("seed").isNotNull(), _middle(_box(F.col("seed")))), origin),
        "anchor": anchor_of(F.col("override_lat"), F.col("override_lon"), F.col("anchor_lat"), F.col("anchor_lon")),
    })


def provisional(outlines: DataFrame) -> DataFrame:
    """What a confirmation shows at once: the outline where its seed implied, calibration and placement pending."""
    p = prepared(outlines)
    return p.withColumns({"calibration_status": F.lit("pending"), "placement_status": F.lit("pending"), "ring_wgs84": F.when(F.col("local_ring").isNotNull(), E.local_ring_to_lonlat("local_ring", "anchor.lon", "anchor.lat"))})


def area_check(area_sqft: Column, stated_sqft: Column, tolerance: float = AREA_TOLERANCE) -> Column:
    """(area_sqft, area_acres, stated_area_sqft, area_diff_pct, area_matches_stated); an unknown or zero stated area compares to nothing."""
    stated = F.when(stated_sqft != 0, stated_sqft)
    off = F.abs(area_sqft - stated) / stated
    return F.struct(F.round(area_sqft, 2).alias("area_sqft"), F.round(area_sqft / T.SQFT_PER_ACRE, 3).alias("area_acres"), stated.alias("stated_area_sqft"), F.round(off * 100, 2).alias("area_diff_pct"), (off <= tolerance).alias("area_matches_stated"))


def rescaled(parcels: DataFrame, scales: DataFrame) -> DataFrame:
    """Area checks at the sheet's scale (REGION, sheet_scale) for parcels (KEY, vertices, stated_area_sqft, issues, self_intersects, scale_ft_per_px).

    Issues about the walked area are replaced by the new check; a parcel without a scale of its own takes the sheet's.
    """
    p = parcels.join(scales.select(*REGION, "sheet_scale"), REGION, "left")
    s, have = F.col("sheet_scale"), F.col("sheet_scale").isNotNull()
    edge = G.path_length(G.close_ring(F.col("vertices"))) * s
    others = F.filter(F.coalesce("issues", F.array().cast("array<string>")), lambda i: ~i.startswith("Walked area") & (i != "area_mismatch"))
    check = area_check(G.ring_area(F.col("vertices")) * s * s, F.col("stated_area_sqft"))
    valid = F.coalesce(check["area_matches_stated"], F.lit(True)) & ~F.coalesce("self_intersects", F.lit(False)) & (F.size(others) == 0)
    return p.withColumns({
        "issues": F.when(have, others).otherwise(F.col("issues")),
        "check": F.when(have, check), "perimeter_ft": F.when(have, F.round(edge, 2)), "valid": F.when(have, valid),
        "scale_ft_per_px": F.coalesce("scale_ft_per_px", "sheet_scale"),
    })


def verified(outlines: DataFrame, lines: DataFrame) -> DataFrame:
    """Confirmed outlines calibrated from the page's printed lines and placed at their anchor.

    ``lines``: document_id, page_number, line_no, text, x1, y1, x2, y2 (page pixels).  Scale and rotation come from
    ``placement.calibrate``; an outline that this does not settle keeps the frame of its seed, or has no place.  The sheet's
    scale (stated areas that agree, else corroborated parcels) settles what single outlines leave open.
    """
    p = prepared(outlines)
    rings = p.select(*KEY, F.col("page_ring").alias("ring"))
    page = ["document_id", "page_number"]
    printed = placement.printed_candidates(lines, page)
    edges = placement.edges_of(rings, KEY)
    near = placement.associate(printed.join(rings.select(*KEY), page), edges, KEY)
    wanted = p.select(*KEY, F.col("page_ring").alias("ring"), "stated_area_sqft", F.col("local_ring").alias("old_ring"), "page_pivot", "local_pivot")
    c = placement.calibrate(near, wanted, KEY)
    pixels = p.select(*KEY, "stated_area_sqft", G.ring_area(F.col("vertices")).alias("pixel_area"))
    by_area = placement.sheet_scale(pixels, REGION).select(*REGION, F.col("sheet_scale").alias("by_area"))
    by_edges = placement.corroborated_scale(c, REGION).select(*REGION, F.col("sheet_scale").alias("by_edges"))
    out = p.join(c.withColumnRenamed("status", "calibration_status"), KEY).join(by_area, REGION, "left").join(by_edges, REGION, "left")
    out = out.withColumn("sheet_scale", F.coalesce("by_area", "by_edges"))
    settled = F.col("scale_ft_per_px").isNotNull() & F.col("rotation_deg").isNotNull()
    turned = G.px_ring_to_local(F.col("page_ring"), F.col("scale_ft_per_px"), F.col("rotation_deg"), F.col("page_pivot"), F.col("local_pivot"))
    # without a rotation, the seed's frame at the scale that is known
    scale = F.coalesce("scale_ft_per_px", "sheet_scale")
    upright = G.px_ring_to_local(F.col("page_ring"), scale, F.lit(0.0), F.col("page_pivot"), F.col("local_pivot"))
    local = F.when(settled, turned).when(scale.isNotNull(), upright).otherwise(F.col("local_ring"))
    out = out.withColumn("local_ring", local)
    out = out.withColumn("ring_wgs84", F.when(F.col("local_ring").isNotNull(), E.local_ring_to_lonlat("local_ring", "anchor.lon", "anchor.lat")))
    return out.withColumns({"check": area_check(G.ring_area(F.col("local_ring")), F.col("stated_area_sqft")), "placement_status": F.when(F.col("local_ring").isNotNull(), "approximate")}).drop("by_area", "by_edges", "seed")


def reanchored(parcels: DataFrame, anchors: DataFrame) -> DataFrame:
    """Confirmed parcels (KEY, local_ring ...) placed again at new anchors (KEY, lat, lon); ``error`` where there is nothing to move."""
    p = parcels.join(anchors.select(*KEY, F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), KEY, "left")
    asked = F.col("_lat").isNotNull() & F.col("_lon").isNotNull()
    able = F.coalesce("human_confirmed", F.lit(False)) & (F.coalesce(F.size("local_ring"), F.lit(0)) >= 3)
    error = F.when(asked & ~F.coalesce("human_confirmed", F.lit(False)), "confirm the boundary first").when(asked & ~able, "an outline needs three points")
    p = p.withColumns({"error": error, "anchor_override": F.when(asked & able, F.struct(F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))), "_move": asked & able})
    ring = E.local_ring_to_lonlat("local_ring", "_lon", "_lat")
    return p.withColumn("ring_wgs84", F.when(F.col("_move"), ring).otherwise(F.col("ring_wgs84"))).drop("_lat", "_lon", "_move")


def stated_area_edits(entities: DataFrame, edits: DataFrame) -> DataFrame:
    """Listed parcels (document_id, page_number, id, stated_area) with the last valid edit of their stated area.

    ``edits``: document_id, page_number, id, text, ts.  A text must read as an area or be empty (back to unknown); the
    first reading stays in ``stated_area_as_read``.
    """
    keys = ["document_id", "page_number", "id"]
    acres = T.acres("text")
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    last = edits.filter(empty | (acres > 0)).groupBy(*keys).agg(F.max_by(F.struct("text", F.round(acres * T.SQFT_PER_ACRE, 2).alias("sqft"), empty.alias("empty")), F.struct("ts", "text")).alias("_e"))
    e = entities.join(last, keys, "left")
    changed = F.col("_e").isNotNull()
    return e.withColumns({
        "stated_area_as_read": F.col("stated_area"),
        "stated_area": F.when(changed, F.when(~F.col("_e.empty"), F.col("_e.text"))).otherwise(F.col("stated_area")),
        "stated_area_sqft": F.when(changed, F.col("_e.sqft")).otherwise(F.round(T.acres("stated_area") * T.SQFT_PER_ACRE, 2)),
    }).drop("_e")


def bound_entities(entities: DataFrame, parcels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parcels with the confirmed polygon of the listed parcel they are evidence of, and parcels made for listed ones that have none.

    ``entities``: document_id, page_number, id, label, evidence_ref (region, parcel) or null, confirmed_polygon; ``parcels``: KEY, ...
    """
    page = ["document_id", "page_number"]
    e = entities.select(*page, F.col("id").alias("_id"), F.col("evidence_ref.region").alias("region_index"), F.col("evidence_ref.parcel").alias("parcel_index"), "confirmed_polygon")
    bound = parcels.join(e, KEY, "left").withColumn("vertices", F.coalesce("confirmed_polygon", "vertices")).withColumn("roster_id", F.coalesce("_id", "roster_id")).drop("_id", "confirmed_polygon")
    drawings = parcels.groupBy(*page).agg(F.min("region_index").alias("region_index"))
    last = parcels.groupBy(*REGION).agg(F.max("parcel_index").alias("_last"))
    free = entities.filter(F.col("evidence_ref").isNull() & F.col("confirmed_polygon").isNotNull()).join(drawings, page).join(last, REGION)
    n = F.row_number().over(Window.partitionBy(*REGION).orderBy("id"))
    made = free.select(*REGION, (F.col("_last") + n).cast("int").alias("parcel_index"), F.col("id").alias("roster_id"), "label", F.col("confirmed_polygon").alias("vertices"))
    return bound, made


def control_members(parcels: DataFrame) -> DataFrame:
    """Confirmed outlines of the regions that control points may place: none if one is pending or already trusted.

    ``parcels``: REGION, vertices, human_confirmed, placement_status, control_fit, anchor_override, manual_position, aliquot_corroborated.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    mine = parcels.filter(yes("human_confirmed") & (F.coalesce(F.size("vertices"), F.lit(0)) > 0))
    trusted = yes("anchor_override") | yes("manual_position") | ((F.col("placement_status") == "surveyed_corner") & ~yes("control_fit")) | yes("aliquot_corroborated")
    held = mine.groupBy(*REGION).agg(F.bool_or((F.coalesce("placement_status", F.lit("")) == "pending") | F.coalesce(trusted, F.lit(False))).alias("held")).filter("not held")
    return mine.join(held.select(*REGION), REGION, "left_semi")


def control_applicable(anchor_source: Column) -> Column:
    """Zones are known only where the document's anchor is a printed state-plane pair."""
    return F.coalesce(F.contains(anchor_source, F.lit("state-plane")), F.lit(False))
