"""Lookups and projections of a processed document: what an assistant or an export asks for, as joins and structs.

``parcels`` has a row a parcel: document_id, page_number, region_index, parcel_index, id, roster_id, label, human_confirmed, ring
(lon/lat) and what each function names.  ``entities`` are a sheet's listed parcels: document_id, page_number, id, label ...
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import patterns as P
from ..functions import text as T
from .evidence import verify
from .matching import PAGE, dedupe_copies, features_in_polygons, label_words
from .moves import max_spread, offset

PLACE = ["document_id", "page_number", "region_index", "parcel_index"]


def located(requests: DataFrame, parcels: DataFrame) -> DataFrame:
    """Each request (PLACE and more) with the parcel at its place; ``error`` says what of the place does not exist."""
    have = parcels.withColumn("_found", F.lit(True))
    pages = parcels.select(*PLACE[:2]).distinct().withColumn("_page", F.lit(True))
    regions = parcels.select(*PLACE[:3]).distinct().withColumn("_region", F.lit(True))
    out = requests.join(have, PLACE, "left").join(pages, PLACE[:2], "left").join(regions, PLACE[:3], "left")
    error = F.when(F.col("_page").isNull(), "no such page").when(F.col("_region").isNull(), "no such region").when(F.col("_found").isNull(), "no such parcel")
    return out.withColumn("error", error).drop("_found", "_page", "_region")


def with_entity(parcels: DataFrame, entities: DataFrame) -> DataFrame:
    """``parcels`` and the listed parcel of their roster_id as struct ``entity`` (null without one)."""
    e = entities.select(*PAGE, F.col("id").alias("roster_id"), F.struct(*[c for c in entities.columns if c not in PAGE]).alias("entity"))
    return parcels.join(e, [*PAGE, "roster_id"], "left")


def stated_acres(extracted: Column, entity: Column) -> Column:
    """Acres as extracted, else as corrected on the listed parcel (stated_area_sqft), else as its text (stated_area) reads; null or zero is unknown."""
    known = lambda v: F.when(v != 0, v)
    return F.coalesce(known(extracted), known(entity["stated_area_sqft"] / T.SQFT_PER_ACRE), known(T.acres(entity["stated_area"])))


def confirmed(parcels: DataFrame) -> DataFrame:
    """Confirmed parcels that lie somewhere."""
    return parcels.filter(F.coalesce("human_confirmed", F.lit(False)) & (F.size("ring") > 0))


def document_text(texts: DataFrame, keys: list[str]) -> DataFrame:
    """All text of a document or page, in order (``texts``: keys, pos, text)."""
    t = texts.filter("text is not null").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return t.select(*keys, F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


def overview(parcels: DataFrame, anchors: DataFrame, sheets: DataFrame) -> DataFrame:
    """One JSON text a document: anchor (lat, lon, precision, source) and, for each sheet with its role, its confirmed parcels' placement.

    ``parcels`` with stated_area_sqft, area_matches_stated, calibration, placement (structs), notes.
    """
    centre = G.vertex_mean(F.col("ring"))
    one = F.struct(
        "region_index", "parcel_index", "label", F.array(F.round(centre["y"], 6), F.round(centre["x"], 6)).alias("centroid_lat_lon"), G.lonlat_area_acres(F.col("ring")).alias("area_acres_on_map"),
        "stated_area_sqft", "area_matches_stated", "calibration", "placement", F.slice(F.coalesce("notes", F.array().cast("array<string>")), 1, 4).alias("notes"),
    )
    listed = confirmed(parcels).groupBy(*PAGE).agg(F.sort_array(F.collect_list(one)).alias("parcels"))
    rows = sheets.select(*PAGE, "role").join(listed, PAGE, "left").withColumn("parcels", F.coalesce("parcels", F.array()))
    by_sheet = rows.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(F.col("page_number").alias("page"), "role", "parcels"))).alias("sheets"))
    return anchors.select("document_id", F.struct("lat", "lon", "precision", "source").alias("anchor")).join(by_sheet, "document_id", "left").select("document_id", F.to_json(F.struct("anchor", "sheets")).alias("overview"))


def location_evidence(sheets: DataFrame, texts: DataFrame) -> DataFrame:
    """Evidence of each sheet (PAGE, e) that its document's text bears out, what it does not in ``dropped``, the factor that turns ground values to grid."""
    own = sheets.join(document_text(texts, ["document_id"]), "document_id", "left").withColumn("checked", verify(F.col("e"), F.coalesce("text", F.lit(""))))
    c = F.col("checked")
    system = c["coordinate_system"]
    factor = F.when((system["coordinates_are"] == "ground") & system["combined_factor"].isNotNull(), 1 / system["combined_factor"])
    return own.select(*PAGE, c["apns"].alias("apns"), c["coordinates"].alias("printed_coordinates"), system.alias("coordinate_system"), factor.alias("ground_to_grid"), *(c[k].alias(k) for k in ("plss", "address", "city", "county", "state", "dropped")), F.col("e.coordinate_system").alias("as_read"))


def parcel_details(parcels: DataFrame, entities: DataFrame) -> DataFrame:
    """Size on the map, printed and computed areas and calibration of each confirmed parcel; ``key`` is its label as it is looked up by."""
    p = with_entity(confirmed(parcels), entities)
    lat = G.vertex_mean(F.col("ring"))["y"]
    axis = lambda a: F.transform("ring", lambda v: v[a])
    extent = lambda a, k: F.round((F.array_max(axis(a)) - F.array_min(axis(a))) * k, 1)
    closed = (F.get("ring", 0) == F.element_at("ring", -1)).cast("int")
    return p.select(
        *PAGE, F.lower(F.trim("label")).alias("key"), "label", (F.size("ring") - closed).alias("corners"),
        F.struct(extent("x", G.M_PER_DEG_LON * F.cos(F.radians(lat))).alias("east_m"), extent("y", F.lit(G.M_PER_DEG_LAT)).alias("north_m")).alias("extent"),
        G.lonlat_area_acres(F.col("ring")).alias("area_acres_on_map"), F.col("entity.stated_area").alias("stated_area_as_printed"), F.col("entity.stated_area_sqft").alias("stated_area_sqft"),
        *(c for c in ("area_diff_pct", "perimeter_ft", "calibration") if c in p.columns),
    )


def county_numbers(wanted: DataFrame, county: DataFrame, centres: DataFrame, most: int = 25) -> tuple[DataFrame, DataFrame]:
    """Where county records (apn, owner, ring) put the numbers a plat prints, and how far apart those lie.

    ``wanted``: PAGE, pos, apn, role, side; ``centres``: PAGE, lon, lat of the confirmed parcels.  A number is looked up by its
    variants in order; the first ``most`` distinct numbers of a page.  Returns a row a number, and a row a page.
    """
    first = wanted.groupBy(*PAGE, "apn").agg(F.min(F.struct("pos", "role", "side")).alias("w"))
    order = F.sort_array(F.collect_list(F.struct(F.col("w.pos").alias("pos"), "apn", "w.role", "w.side")))
    listed = first.groupBy(*PAGE).agg(F.slice(order, 1, most).alias("a")).select(*PAGE, F.explode("a").alias("a")).select(*PAGE, "a.*")
    tried = listed.select(*PAGE, "apn", F.posexplode(T.apn_variants("apn")).alias("i", "_v"))
    hits = tried.join(county.withColumnRenamed("apn", "_v"), "_v").groupBy(*PAGE, "apn").agg(F.min(F.struct("i", "owner", "ring")).alias("h"))
    rows = listed.join(hits, [*PAGE, "apn"], "left").join(centres.select(*PAGE, F.col("lon").alias("_lon"), F.col("lat").alias("_lat")), PAGE, "left")
    at = G.vertex_mean(F.col("h.ring"))
    rows = rows.select(*PAGE, "pos", "apn", "role", "side", F.col("h").isNotNull().alias("found"), F.col("h.owner").alias("owner"), F.when(F.col("h").isNotNull(), G.lonlat_area_acres(F.col("h.ring"))).alias("area_acres"), at["x"].alias("lon"), at["y"].alias("lat"), F.when(F.col("h").isNotNull() & F.col("_lon").isNotNull(), offset(F.col("_lon"), F.col("_lat"), at["x"], at["y"])).alias("from_parcels"))
    spread = max_spread(rows.filter("found").select(*PAGE, "lon", "lat"), PAGE)
    pages = rows.groupBy(*PAGE).agg(F.count_if("found").alias("found")).join(spread, PAGE, "left")
    return rows, pages.withColumn("max_spread_between_found_m", F.when(F.col("found") >= 2, F.round("spread_m", 1))).drop("spread_m")


def services_of(services: DataFrame, state: str | None) -> DataFrame:
    """Record services (pos, state ...) of a state, or all of them, the first one first."""
    mine = services if state is None else services.filter(F.lower("state") == state.lower())
    return mine.orderBy("pos")


def osm_features(elements: DataFrame) -> DataFrame:
    """Elements (type, lat, lon, center) with a position: a node's own, else the centre; those without go."""
    x, y = (F.when(F.col("type") == "node", F.col(c)).otherwise(F.col(f"center.{c}")) for c in ("lon", "lat"))
    return elements.withColumns({"x": x, "y": y}).filter("x is not null and y is not null")


def features_in_area(polygons: DataFrame, elements: DataFrame, kind: str) -> DataFrame:
    """Number of map features whose tag ``amenity`` is ``kind`` in each polygon (polygon_id, ring)."""
    return features_in_polygons(polygons, osm_features(elements.filter(F.col("amenity") == kind)).select("x", "y"))


def whole_match(text: Column, pattern: str) -> Column:
    """Whether a text is one hit of a pattern and blanks around it."""
    return F.coalesce(text, F.lit("")).rlike(rf"^\s*(?:{pattern})\s*$")


def labels_incomplete(lines: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a sheet has northing or easting lines that no complete pair holds."""
    count = lambda p: F.count_if(whole_match(F.col("text"), "(?i)" + p))
    seen = lines.groupBy(*keys).agg(count(P.NORTHING).alias("n"), count(P.EASTING).alias("e"))
    have = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"))
    out = seen.join(have, keys, "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
    return out.withColumn("incomplete", (F.col("n") != F.col("pairs")) | (F.col("e") != F.col("pairs")))


def feature_offsets(features: DataFrame, boxes: DataFrame, keys: list[str], tolerance: float = 25.0) -> DataFrame:
    """Pixels by which a group of outlines (``boxes``: keys, left, top, right, bottom) has to move so that its side lies on a located line.

    ``features``: keys, name, side (east, west, north or south) and the line's ends x1, y1, x2, y2.  Lines that run over
    ``tolerance`` degrees off their side are left out.
    """
    f = features.join(boxes, keys)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    tilt = F.pmod(F.abs(F.degrees(F.atan2(dy, dx))), F.lit(180.0))  # 0 is level
    upright = F.col("side").isin("east", "west")
    off = F.when(upright, F.abs(tilt - 90)).when(F.col("side").isin("north", "south"), F.least(tilt, 180 - tilt))
    at = lambda along, run, rise, base, middle: F.when(F.abs(run) < 1e-6, base).otherwise(base + rise * (middle - along) / run)
    x_at = at(F.col("y1"), dy, dx, F.col("x1"), (F.col("top") + F.col("bottom")) / 2)
    y_at = at(F.col("x1"), dx, dy, F.col("y1"), (F.col("left") + F.col("right")) / 2)
    side = lambda name, c: F.when(F.col("side") == name, F.col(c))
    move_x = x_at - F.coalesce(side("east", "right"), side("west", "left"))
    move_y = y_at - F.coalesce(side("south", "bottom"), side("north", "top"))
    return f.filter(off <= tolerance).select(*features.columns, F.when(upright, move_x).alias("dx_px"), F.when(~upright, move_y).alias("dy_px"))


def boundary_refs(parcels: DataFrame, entities: DataFrame, sheets: DataFrame) -> DataFrame:
    """Everything on a document's sheets whose boundary could be confirmed: listed parcels with their drawing, then drawings that none lists."""
    drawn = parcels.filter(F.col("roster_id").isNotNull()).select(*PAGE, F.col("roster_id").alias("id"), "region_index", "parcel_index", "region_area", "human_confirmed")
    listed = entities.select(*PAGE, "id", "label", "excluded_reason").join(drawn, [*PAGE, "id"], "left").withColumn("listed", F.lit(True))
    loose = parcels.filter(F.col("roster_id").isNull()).select(*PAGE, "id", "label", F.lit(None).cast("string").alias("excluded_reason"), "region_index", "parcel_index", "region_area", "human_confirmed", F.lit(False).alias("listed"))
    out = listed.unionByName(loose.select(listed.columns)).join(sheets.select(*PAGE, "role"), PAGE, "left")
    return out.withColumn("human_confirmed", F.coalesce("human_confirmed", F.lit(False)))


def other_sheet_copies(refs: DataFrame) -> DataFrame:
    """Refs (document_id, page_number, id, label, acres, role) of sheets that are no target map and repeat a parcel of one that is."""
    role = F.coalesce(F.col("role") == "target_parcel_map", F.lit(False))
    named = refs.select("*", role.alias("_target"), F.array_sort(label_words(F.col("label"))).alias("_words"), F.when(~F.isnan("acres"), F.col("acres").cast("double")).alias("_acres")).filter(F.size("_words") > 0)
    # what decides are word sets and areas: each is taken once for all its copies
    cases = named.groupBy("document_id", "_words", "_target", "_acres").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    sets = cases.select("document_id", "_words", "_target").distinct()
    spelled = sets.select("document_id", "_words", "_target", F.explode("_words").alias("_w"))
    often = spelled.groupBy("document_id", "_w").agg(F.count(F.lit(1)).alias("_often"))
    # of two sets the smaller one's rarest word is in the larger one, too
    rarest = spelled.join(often, ["document_id", "_w"]).groupBy("document_id", "_words", "_target").agg(F.min(F.struct("_often", "_w"))["_w"].alias("_w"))
    of = lambda df, target, name: df.filter("_target" if target else "not _target").select("document_id", "_w", F.col("_words").alias(name))
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    up = of(rarest, False, "_words").join(of(spelled, True, "_theirs"), ["document_id", "_w"]).filter(within("_words", "_theirs"))
    down = of(spelled, False, "_words").join(of(rarest, True, "_theirs"), ["document_id", "_w"]).filter(within("_theirs", "_words"))
    met = up.unionByName(down).select("document_id", "_words", "_theirs").distinct()
    # of a set's areas the next ones below and above are the nearest in their proportion, too
    ours = cases.filter("not _target").join(met, ["document_id", "_words"]).select("document_id", "_theirs", "_words", "_acres", F.lit(False).alias("_target"))
    theirs = cases.filter("_target").select("document_id", F.col("_words").alias("_theirs"), F.lit(None).cast("array<string>").alias("_words"), "_acres", F.lit(True).alias("_target"))
    set_ = Window.partitionBy("document_id", "_theirs")
    so_far = lambda order: F.last(F.when(F.col("_target"), F.col("_acres")), True).over(set_.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    before, after = so_far(F.col("_acres").asc()), so_far(F.col("_acres").desc())
    unstated = F.bool_or(F.col("_target") & F.col("_acres").isNull()).over(set_)
    any_ = F.bool_or("_target").over(set_)
    near = lambda c: F.coalesce(F.abs(F.col("_acres") - F.col(c)) <= 0.08 * F.greatest("_acres", c), F.lit(False))
    seen = ours.unionByName(theirs).select("*", before.alias("_before"), after.alias("_after"), unstated.alias("_unstated"), any_.alias("_any"))
    hits = seen.filter(~F.col("_target") & F.col("_any") & (F.col("_unstated") | F.col("_acres").isNull() | near("_before") | near("_after"))).select("document_id", "_words", "_acres").distinct()
    a, b = named.filter("not _target").alias("a"), hits.alias("b")
    same = (F.col("a.document_id") == F.col("b.document_id")) & (F.col("a._words") == F.col("b._words")) & F.col("a._acres").eqNullSafe(F.col("b._acres"))
    ids = a.join(b, same, "left_semi").select(*PAGE, "id").distinct()
    return refs.filter(~role).join(ids, [*PAGE, "id"], "left_semi")


def primary_refs(refs: DataFrame) -> DataFrame:
    """One ref of each parcel of a document, copies on other sheets left out."""
    return dedupe_copies(refs)


def owned(access: DataFrame, email: Column | str) -> DataFrame:
    """Documents of an owner, the newest first; without a date they come last."""
    who = F.lit(email) if isinstance(email, str) else email
    return access.filter(F.col("owner") == who).orderBy(F.coalesce("created", F.lit(0)).desc(), "document_id")


def file_of(own: DataFrame, parents: DataFrame, samples: DataFrame) -> DataFrame:
    """Each document's path of a file: its own (document_id, name, path), else that of the sample it was opened from (document_id, sample_id)."""
    theirs = samples.select(F.col("document_id").alias("sample_id"), "name", F.col("path").alias("_path"))
    wanted = parents.join(theirs, "sample_id", "left").select("document_id", "name", "_path").filter("name is not null")
    out = own.join(wanted, ["document_id", "name"], "full_outer")
    return out.select("document_id", "name", F.coalesce("path", "_path").alias("path"), (F.col("path").isNull()).alias("from_sample"))


def check_text(name: Column, out: Column) -> Column:
    """One plain line on what a lookup found; ``out`` is a struct with what the line tells."""
    n = lambda c: out[c].cast("string")
    return (
        F.when(out["error"].isNotNull(), F.concat(F.lit("Could not complete: "), out["error"]))
        .when(name == "lookup_county_apns", F.concat(F.lit("Looked up "), n("asked"), F.lit(" APNs in the county records: "), n("found"), F.lit(" found")))
        .when(name == "county_parcels_near", F.concat(F.lit("Found "), n("found"), F.lit(" county parcels near a point")))
        .when(name == "evaluate_position", F.concat(F.lit("Tested a move: "), n("hugging_pct"), F.lit("% of the outline against a neighbouring parcel, "), n("overlap_pct"), F.lit("% overlap")))
        .when(name == "search_document_text", F.concat(F.lit("Searched the document text: "), n("found"), F.lit(" hits")))
        .otherwise(name)
    )


def strong_fit(check: Column) -> Column:
    """A county fit good enough to move a sheet on."""
    return F.coalesce(check["corroborated"], F.lit(False)) | ((F.coalesce(check["hugging_pct"], F.lit(0.0)) >= 50) & (F.coalesce(check["overlap_pct"], F.lit(0.0)) <= 3))
