"""Confirmations, lookups, model payloads and curve edits on small cases."""

import json
import math
import time

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators import confirm, matching, outline, payloads, views

RING = "array<struct<x:double,y:double>>"
CALLS = "array<struct<bearing:string,distance:string>>"


def xy(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def square(side):
    return [{"bearing": b, "distance": str(side)} for b in ("N0°00'00\"E", "N90°00'00\"E", "S0°00'00\"E", "S90°00'00\"W")]


OUTLINE = f"document_id string, page_number int, region_index int, parcel_index int, confirmation_id string, vertices {RING}, region struct<class:string,bbox:struct<x:double,y:double,w:double,h:double>>, page_width double, page_height double, calls {CALLS}, stated_area_sqft double, anchor_lat double, anchor_lon double, override_lat double, override_lon double"


def outline_row(k, vertices, calls, stated=None, override=(None, None)):
    return ("d", 1, 0, k, "c1", xy(vertices), ("ParcelMap", (100.0, 100.0, 1000.0, 800.0)), 1500.0, 1200.0, calls, stated, 39.5, -119.8, *override)


def test_crops_and_anchors(spark):
    df = spark.createDataFrame([outline_row(0, [(0, 0)], []), outline_row(1, [(0, 0)], [], override=(40.0, -120.0))], OUTLINE)
    r = df.select(confirm.crop_box(F.col("region"), F.col("page_width"), F.col("page_height")).alias("c"), confirm.anchor_of(F.col("override_lat"), F.col("override_lon"), F.col("anchor_lat"), F.col("anchor_lon")).alias("a")).collect()
    c = r[0]["c"]
    assert (c["x"], c["y"]) == (20.0, 36.0) and c["x"] + c["w"] == 1180.0 and c["y"] + c["h"] == 964.0
    assert [tuple(x["a"]) for x in r] == [(39.5, -119.8), (40.0, -120.0)]


def test_provisional_place_is_the_seeds(spark):
    """The display fit is inverted: the outline drawn over the seed comes back as the seed."""
    w, h = 1160.0, 928.0
    scale = min(w * 0.85 / 500, h * 0.85 / 500)
    drawn = [(w / 2 + (x - 250) * scale, h / 2 - (y - 250) * scale) for x, y in ((0, 0), (0, 500), (500, 500), (500, 0))]
    df = spark.createDataFrame([outline_row(0, drawn, square(500)), outline_row(1, drawn, [])], OUTLINE)
    got = {r["parcel_index"]: r for r in confirm.provisional(df).collect()}
    assert [(round(p["x"], 6), round(p["y"], 6)) for p in got[0]["local_ring"]] == [(0, 0), (0, 500), (500, 500), (500, 0)]
    assert got[0]["ring_wgs84"][0]["x"] == pytest.approx(-119.8) and got[0]["ring_wgs84"][0] == got[0]["ring_wgs84"][-1]
    assert got[0]["calibration_status"] == "pending" and got[1]["ring_wgs84"] is None


def test_verified_outline_is_scaled_and_turned_by_print(spark):
    """A rectangle of 500 by 250 ft at half a foot a pixel, printed with bearings two degrees off the drawing."""
    page = [(200, 300), (1200, 300), (1200, 800), (200, 800)]
    crop = (20.0, 36.0)
    az = {0: 92, 1: 182, 2: 272, 3: 2}
    vertices = [(x - crop[0], y - crop[1]) for x, y in page]
    calls = [{"bearing": b, "distance": d} for b, d in (("N 2°00'00\"E", "250"), ("S88°00'00\"E", "500"), ("S 2°00'00\"W", "250"), ("N88°00'00\"W", "500"))]
    df = spark.createDataFrame([outline_row(0, vertices, calls, 125_000.0), outline_row(1, vertices, calls, 1.0), outline_row(2, vertices, [], None)], OUTLINE)
    text = {"a": ("S 88°00'00\" E  500.00'", 600, 320, 800, 340), "b": ("N 2°00'00\" E 250.00'", 215, 500, 235, 600), "c": ("250.0", 1165, 500, 1185, 600)}
    lines = spark.createDataFrame([("d", 1, i, *map(lambda v: float(v) if not isinstance(v, str) else v, t)) for i, t in enumerate(text.values())], "document_id string, page_number int, line_no int, text string, x1 double, y1 double, x2 double, y2 double")
    got = {r["parcel_index"]: r for r in confirm.verified(df, lines).collect()}
    r = got[0]
    assert r["calibration_status"] == "cross_validated" and r["scale_ft_per_px"] == pytest.approx(0.5) and min(r["rotation_deg"] % 180, 180 - r["rotation_deg"] % 180) == pytest.approx(2.0, abs=0.01)
    assert r["check"]["area_matches_stated"] and r["check"]["area_sqft"] == pytest.approx(125_000, rel=1e-6)
    p = r["local_ring"]
    assert math.dist((p[0]["x"], p[0]["y"]), (p[1]["x"], p[1]["y"])) == pytest.approx(500)
    assert G.direction is not None and math.degrees(math.atan2(p[1]["x"] - p[0]["x"], p[1]["y"] - p[0]["y"])) % 360 == pytest.approx(az[0], abs=0.01)
    assert got[1]["calibration_status"] == "unverified" and got[1]["local_ring"] is not None  # the seed's frame, at no agreed scale
    assert got[2]["calibration_status"] == "unverified"


def test_rescaled_checks(spark):
    rows = [("d", 1, 0, 0, xy([(0, 0), (100, 0), (100, 100), (0, 100)]), 40_000.0, ["Walked area differs", "Other"], False, None), ("d", 1, 0, 1, xy([(0, 0), (100, 0), (100, 50), (0, 50)]), 30_000.0, [], False, 2.1), ("d", 1, 9, 0, xy([(0, 0), (1, 0), (1, 1)]), None, ["Walked area"], None, None)]
    p = spark.createDataFrame(rows, f"document_id string, page_number int, region_index int, parcel_index int, vertices {RING}, stated_area_sqft double, issues array<string>, self_intersects boolean, scale_ft_per_px double")
    scales = spark.createDataFrame([("d", 1, 0, 2.0)], "document_id string, page_number int, region_index int, sheet_scale double")
    got = {(r["region_index"], r["parcel_index"]): r for r in confirm.rescaled(p, scales).collect()}
    assert got[0, 0]["check"]["area_matches_stated"] and got[0, 0]["issues"] == ["Other"] and not got[0, 0]["valid"] and got[0, 0]["perimeter_ft"] == 800.0 and got[0, 0]["scale_ft_per_px"] == 2.0
    assert not got[0, 1]["check"]["area_matches_stated"] and got[0, 1]["check"]["area_diff_pct"] == pytest.approx(33.33) and got[0, 1]["scale_ft_per_px"] == 2.1
    assert got[9, 0]["check"] is None and got[9, 0]["issues"] == ["Walked area"]


def test_moved_anchors_and_edits(spark):
    rows = [("d", 1, 0, k, xy([(0, 0), (0, 100), (100, 100)][: 3 - 2 * (k == 2)]), k != 1, xy([(0, 0)])) for k in range(4)]
    p = spark.createDataFrame(rows, f"document_id string, page_number int, region_index int, parcel_index int, local_ring {RING}, human_confirmed boolean, ring_wgs84 {RING}")
    anchors = spark.createDataFrame([("d", 1, 0, k, 39.0, -120.0) for k in range(3)], "document_id string, page_number int, region_index int, parcel_index int, lat double, lon double")
    got = {r["parcel_index"]: r for r in confirm.reanchored(p, anchors).collect()}
    assert got[0]["ring_wgs84"][0]["x"] == pytest.approx(-120.0) and got[0]["error"] is None and got[0]["anchor_override"]["lat"] == 39.0
    assert got[1]["error"] == "confirm the boundary first" and got[2]["error"] == "an outline needs three points" and got[3]["error"] is None and len(got[3]["ring_wgs84"]) == 1
    entities = spark.createDataFrame([("d", 1, "a", "2.5 AC"), ("d", 1, "b", "1 ACRE"), ("d", 1, "c", "3 AC")], "document_id string, page_number int, id string, stated_area string")
    edits = spark.createDataFrame([("d", 1, "a", "3 ACRES", 1), ("d", 1, "a", "nonsense", 2), ("d", 1, "b", "2 AC", 1), ("d", 1, "b", " ", 2)], "document_id string, page_number int, id string, text string, ts int")
    got = {r["id"]: r for r in confirm.stated_area_edits(entities, edits).collect()}
    assert (got["a"]["stated_area"], got["a"]["stated_area_sqft"], got["a"]["stated_area_as_read"]) == ("3 ACRES", 130_680.0, "2.5 AC")
    assert got["b"]["stated_area"] is None and got["b"]["stated_area_sqft"] is None and got["c"]["stated_area_sqft"] == 130_680.0


def test_bindings_and_control_members(spark):
    ents = spark.createDataFrame([("d", 1, "p1-x1", "A", (0, 0), xy([(0, 0), (1, 0), (1, 1)])), ("d", 1, "p1-x2", "B", None, xy([(5, 5), (6, 5), (6, 6)])), ("d", 1, "p1-x3", "C", None, None)], f"document_id string, page_number int, id string, label string, evidence_ref struct<region:int,parcel:int>, confirmed_polygon {RING}")
    parcels = spark.createDataFrame([("d", 1, 0, 0, None, xy([(9, 9)])), ("d", 1, 0, 1, None, xy([(8, 8)]))], f"document_id string, page_number int, region_index int, parcel_index int, roster_id string, vertices {RING}")
    bound, made = confirm.bound_entities(ents, parcels)
    b = {r["parcel_index"]: r for r in bound.collect()}
    assert b[0]["roster_id"] == "p1-x1" and len(b[0]["vertices"]) == 3 and b[1]["roster_id"] is None and len(b[1]["vertices"]) == 1
    assert [(r["parcel_index"], r["roster_id"]) for r in made.collect()] == [(2, "p1-x2")]
    rows = [("d", 1, r, xy([(0, 0)]) if r != 4 else [], True, status, None, None, manual, None) for r, status, manual in ((0, None, None), (1, "pending", None), (2, "surveyed_corner", None), (3, "approximate", True), (4, None, None), (0, "approximate", None), (5, "surveyed_corner", None))]
    df = spark.createDataFrame(rows, f"document_id string, page_number int, region_index int, vertices {RING}, human_confirmed boolean, placement_status string, control_fit boolean, anchor_override boolean, manual_position boolean, aliquot_corroborated boolean")
    df = df.withColumn("control_fit", F.col("region_index") == 5)
    assert sorted(r["region_index"] for r in confirm.control_members(df).collect()) == [0, 0, 5]
    assert [r[0] for r in spark.createDataFrame([("state-plane pair",), ("geocoder",), (None,)], "s string").select(confirm.control_applicable(F.col("s"))).collect()] == [True, False, False]


def test_payloads(spark):
    roles = [{"image_number": 1, "role": "target_parcel_map", "reason": "  north  arrow "}, {"image_number": 2, "role": "poem"}, {"image_number": 9, "role": "not_a_map"}, {"image_number": 1, "role": "not_a_map", "reason": " "}, {"role": "not_a_map"}]
    df = spark.createDataFrame([("d", json.dumps(roles), 3), ("e", "no json", 3), ("f", None, 2)], "document_id string, payload string, count int")
    assert [tuple(r) for r in payloads.sheet_roles(df).collect()] == [("d", 0, "not_a_map", None)]
    lists = [{"image_number": 2, "parcels": [{"label": "LOT 1", "printed_id": "N/A", "stated_area": "2 AC"}, {"label": "lot 1"}, {"label": ""}]}, {"image_number": 1, "parcels": None}]
    got = payloads.rosters(spark.createDataFrame([("d", json.dumps(lists), 2)], "document_id string, payload string, count int")).collect()
    assert [(r["page_number"], r["label"], r["printed_id"], r["stated_area"]) for r in got] == [(1, "LOT 1", None, "2 AC")]
    where = [{"image_number": 1, "location": {"county": "Washoe", "apns": [{"apn": "123-456-78", "role": "subject"}]}}, {"image_number": 2, "location": "here"}]
    got = payloads.roster_locations(spark.createDataFrame([("d", json.dumps(where), 2)], "document_id string, payload string, count int")).collect()
    assert len(got) == 1 and got[0]["image"] == 0 and got[0]["location"]["county"] == "Washoe" and got[0]["location"]["apns"][0]["apn"] == "123-456-78"
    edges = {"edges": [{"edge_index": 0, "distance_ft": 100, "bearing_text": "N 61\x0053'54\" E"}, {"edge_index": 4, "distance_ft": 5}, {"edge_index": 1, "distance_ft": True}, {"edge_index": 2, "distance_ft": -3}, {"edge_index": True, "distance_ft": 9}, {"edge_index": 3, "distance_ft": 7.5, "bearing_text": "??"}, {"edge_index": 1.5, "distance_ft": 2}]}
    r = spark.createDataFrame([(json.dumps(edges),), ("{}",), (None,)], "p string").select(payloads.edge_labels(F.col("p"), F.lit(4)).alias("e")).collect()
    assert [(e["edge_index"], e["value"]) for e in r[0]["e"]] == [(0, 100.0), (3, 7.5)] and r[0]["e"][0]["azimuth"] == pytest.approx(61.8983333) and r[0]["e"][1]["azimuth"] is None
    assert r[1]["e"] == [] and not r[2]["e"]


def test_lookups(spark):
    ring = xy([(-119.8, 39.5), (-119.799, 39.5), (-119.799, 39.501), (-119.8, 39.501), (-119.8, 39.5)])
    parcels = spark.createDataFrame([("d", 1, 0, 0, "i1", "r1", " Lot A", True, ring, 4.0, None), ("d", 1, 0, 1, "i2", None, "Lot B", True, [], 0.0, None), ("d", 1, 1, 0, "i3", "r3", "Lot C", False, ring, None, None)], f"document_id string, page_number int, region_index int, parcel_index int, id string, roster_id string, label string, human_confirmed boolean, ring {RING}, acres double, stated_area_sqft double")
    asked = spark.createDataFrame([("d", 1, 0, 0), ("d", 1, 0, 7), ("d", 1, 3, 0), ("d", 2, 0, 0)], "document_id string, page_number int, region_index int, parcel_index int")
    got = {(r["page_number"], r["region_index"], r["parcel_index"]): (r["id"], r["error"]) for r in views.located(asked, parcels).collect()}
    assert got == {(1, 0, 0): ("i1", None), (1, 0, 7): (None, "no such parcel"), (1, 3, 0): (None, "no such region"), (2, 0, 0): (None, "no such page")}
    entities = spark.createDataFrame([("d", 1, "r1", "2 AC", 43_560.0), ("d", 1, "r3", "5 ACRES", None)], "document_id string, page_number int, id string, stated_area string, stated_area_sqft double")
    acres = {r["id"]: r["a"] for r in views.with_entity(parcels, entities).withColumn("a", views.stated_acres(F.col("acres"), F.col("entity"))).collect()}
    assert acres == {"i1": 4.0, "i2": None, "i3": 5.0}
    assert [r["id"] for r in views.confirmed(parcels).collect()] == ["i1"]
    d = views.parcel_details(parcels, entities).first()
    assert (d["key"], d["corners"], d["stated_area_as_printed"]) == ("lot a", 4, "2 AC") and d["extent"]["north_m"] == pytest.approx(110.5, abs=0.1) and d["extent"]["east_m"] == pytest.approx(85.9, abs=0.1)
    texts = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a"), ("d", 3, None)], "document_id string, pos int, text string")
    assert views.document_text(texts, ["document_id"]).first()["text"] == "a\nb"
    full = parcels.withColumns({"area_matches_stated": F.lit(True), "calibration": F.struct(F.lit("x").alias("status")), "placement": F.struct(F.lit("y").alias("status")), "notes": F.array(*map(F.lit, "abcdef"))})
    anchors = spark.createDataFrame([("d", 39.5, -119.8, "city", "geocoder")], "document_id string, lat double, lon double, precision string, source string")
    sheets = spark.createDataFrame([("d", 1, "target_parcel_map"), ("d", 2, None)], "document_id string, page_number int, role string")
    o = json.loads(views.overview(full, anchors, sheets).first()["overview"])
    assert o["anchor"]["source"] == "geocoder" and [s["page"] for s in o["sheets"]] == [1, 2] and o["sheets"][0]["parcels"][0]["notes"] == list("abcd") and o["sheets"][1]["parcels"] == []
    county = spark.createDataFrame([("012-1", "O", ring), ("7-7", "P", xy([(-119.7, 39.5), (-119.699, 39.5), (-119.699, 39.501)]))], f"apn string, owner string, ring {RING}")
    wanted = spark.createDataFrame([("d", 1, 0, "12-1", "subject", None), ("d", 1, 1, "7-7", None, "N"), ("d", 1, 2, "9-9", None, None), ("d", 1, 3, "12-1", None, None)], "document_id string, page_number int, pos int, apn string, role string, side string")
    centres = spark.createDataFrame([("d", 1, -119.8, 39.5)], "document_id string, page_number int, lon double, lat double")
    rows, pages = views.county_numbers(wanted, county, centres)
    got = {r["apn"]: r for r in rows.collect()}
    assert {k: r["found"] for k, r in got.items()} == {"12-1": True, "7-7": True, "9-9": False} and got["7-7"]["from_parcels"]["east_m"] > 8000
    assert pages.first()["found"] == 2 and pages.first()["max_spread_between_found_m"] == pytest.approx(8600, rel=0.02)


def test_labels_features_and_copies(spark):
    lines = spark.createDataFrame([("a", " N 14,834,576.9 "), ("a", "E 2,289,281.05"), ("a", "N 123456 and more"), ("b", "N 14834576"), ("c", "x")], "k string, text string")
    pairs = spark.createDataFrame([("a",)], "k string")
    assert {r["k"]: r["incomplete"] for r in views.labels_incomplete(lines, pairs, ["k"]).collect()} == {"a": False, "b": True, "c": False}
    boxes = spark.createDataFrame([(1, 100.0, 100.0, 300.0, 200.0)], "k int, left double, top double, right double, bottom double")
    feats = spark.createDataFrame([(1, "road", "east", 340.0, 0.0, 360.0, 300.0), (1, "creek", "north", 0.0, 50.0, 400.0, 50.0), (1, "rail", "west", 0.0, 0.0, 100.0, 10.0), (1, "x", "up", 0.0, 0.0, 1.0, 1.0)], "k int, name string, side string, x1 double, y1 double, x2 double, y2 double")
    got = {r["name"]: (r["dx_px"], r["dy_px"]) for r in views.feature_offsets(feats, boxes, ["k"]).collect()}
    assert got == {"road": (50.0, None), "creek": (None, -50.0)}
    refs = spark.createDataFrame([("d", 1, "a", "LOT 5", 2.0, "target_parcel_map"), ("d", 2, "b", "Lot 5", 2.1, "reference_survey"), ("d", 2, "c", "Lot 6", None, "reference_survey"), ("d", 3, "e", "LOT 5", 9.0, None), ("d", 3, "f", "5", None, None)], "document_id string, page_number int, id string, label string, acres double, role string")
    assert sorted(r["id"] for r in views.other_sheet_copies(refs).collect()) == ["b", "f"]
    elements = spark.createDataFrame([("node", 0.5, 0.5, None, "school"), ("way", None, None, (0.2, 0.3), "school"), ("way", None, None, None, "school"), ("node", 5.0, 5.0, None, "school"), ("node", 0.1, 0.1, None, "bank")], "type string, lat double, lon double, center struct<lat:double,lon:double>, amenity string")
    polygons = spark.createDataFrame([(1, xy([(0, 0), (1, 0), (1, 1), (0, 1)]))], f"polygon_id int, ring {RING}")
    assert views.features_in_area(polygons, elements, "school").first()["n"] == 2
    own = spark.createDataFrame([("a", "x", "a/x")], "document_id string, name string, path string")
    parents, samples = spark.createDataFrame([("a", "s"), ("b", None)], "document_id string, sample_id string"), spark.createDataFrame([("s", "x", "s/x"), ("s", "y", "s/y")], "document_id string, name string, path string")
    assert {(r["document_id"], r["name"]): r["path"] for r in views.file_of(own, parents, samples).collect()} == {("a", "x"): "a/x", ("a", "y"): "s/y"}
    access = spark.createDataFrame([("a", "me", 5), ("b", "me", None), ("c", "you", 9), ("d", "me", 7)], "document_id string, owner string, created int")
    assert [r["document_id"] for r in views.owned(access, "me").collect()] == ["d", "a", "b"]


def test_curve_edits(spark):
    ring = xy([(0, 0), (100, 0), (100, 100), (0, 100)])
    curves = {0: [{"a": 0.25, "b": 0.1}, {"a": 0.75, "b": 0.2}], 2: [{"a": 0.5, "b": 0.3}]}
    df = spark.createDataFrame([(ring, curves)], f"ring {RING}, curves map<int,array<struct<a:double,b:double>>>")
    point = F.struct(F.lit(50.0).alias("x"), F.lit(0.0).alias("y"))
    r = df.select(outline.curves_after_insert(F.col("ring"), F.col("curves"), F.lit(0), point).alias("i"), outline.curves_after_delete(F.col("curves"), F.lit(1), F.lit(4)).alias("d"), outline.curves_after_delete(F.col("curves"), F.lit(0), F.lit(4)).alias("e")).first()
    way = lambda w: [(round(p["a"], 9), round(p["b"], 9)) for p in w]
    assert {k: way(v) for k, v in r["i"].items()} == {0: [(0.5, 0.2)], 1: [(0.5, 0.4)], 3: [(0.5, 0.3)]}
    assert {k: way(v) for k, v in r["d"].items()} == {1: [(0.5, 0.3)]} and {k: way(v) for k, v in r["e"].items()} == {1: [(0.5, 0.3)]}
    saved = spark.createDataFrame([('{"3": [0.5, 0.4], "1": [[0.2, 0.1], [0.6, -0.1]], "2": []}',), ("null",), (None,)], "t string").select(outline.migrated_curves(F.col("t")).alias("c")).collect()
    assert {k: way(v) for k, v in saved[0]["c"].items()} == {3: [(0.5, 0.2)], 1: [(0.2, 0.1), (0.6, -0.1)]} and not saved[1]["c"] and not saved[2]["c"]
    m = df.select(outline.edge_midpoint("ring", "curves", F.lit(1), F.lit(0.0), F.lit(0.0)).alias("m"), outline.nearest_on_edge("ring", "curves", F.lit(1), F.lit(130.0), F.lit(40.0)).alias("n"), outline.nearest_on_edge("ring", "curves", F.lit(2), F.lit(50.0), F.lit(-500.0)).alias("c")).first()
    assert tuple(m["m"]) == (100.0, 50.0) and tuple(m["n"]) == (100.0, 40.0) and m["c"]["y"] < 100.0


def test_other_sheet_copies_are_those_of_all_pairs_and_meet_as_sets(spark):
    """Copies of a label are met once: pairs of rows grow with the square of the copies."""
    import random

    rng = random.Random(3)
    words, nan = ["LOT", "TRACT", "A", "B", "7-1", ""], float("nan")
    sides = [None, nan, 0.0, -1.0, 1.0, 1.05, 1.1, 2.0, 2.17, 2.2, 40.0]
    rows = [("d%d" % rng.randint(0, 2), 1, i, rng.choice([None, " ".join(rng.sample(words, rng.randint(0, 3)))]), rng.choice(sides), rng.choice(["target_parcel_map", "other", None])) for i in range(200)]
    refs = spark.createDataFrame(rows, "document_id string, page_number int, id int, label string, acres double, role string").cache()
    a, b = refs.filter("not coalesce(role = 'target_parcel_map', false)").alias("a"), refs.filter("role = 'target_parcel_map'").alias("b")
    c = F.col
    want = a.join(b, c("a.document_id") == c("b.document_id")).filter(matching.same_parcel(c("a.label"), c("b.label"), c("a.acres"), c("b.acres"))).select("a.id").distinct()
    assert sorted(r["id"] for r in views.other_sheet_copies(refs).collect()) == sorted(r["id"] for r in want.collect())
    # 20,000 copies of one label on either side: 400 million pairs of rows
    one = spark.range(40000).selectExpr("'d' as document_id", "1 as page_number", "id", "'LOT A' as label", "cast(id % 2 * 100 as double) as acres", "if(id % 4 < 2, 'target_parcel_map', 'other') as role")
    start = time.time()
    assert views.other_sheet_copies(one).count() == 20000
    assert time.time() - start < 60
