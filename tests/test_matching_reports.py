import csv
import io
import json
import random
import struct
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators import matching, quality, report, sheets, status
from plumbline.sources import exports, tables
from plumbline.streaming import progress

RING = "array<struct<x:double,y:double>>"
BOX = "struct<x:double,y:double,w:double,h:double>"


def test_lines_go_to_the_smallest_region(spark):
    regions = spark.createDataFrame([("d", 1, 0, "Text", (0.0, 0.0, 100.0, 100.0)), ("d", 1, 1, "Table", (10.0, 10.0, 20.0, 20.0)), ("d", 1, 2, "Logo", (0.0, 0.0, 5.0, 5.0)), ("d", 2, 0, "Text", (0.0, 0.0, 1.0, 1.0))], f"document_id string, page_number int, region_index int, class string, bbox {BOX}")
    at = lambda x, y: (x, y, x, y)
    lines = spark.createDataFrame([("d", 1, 2, "b", 0.5, at(15.0, 15.0)), ("d", 1, 1, "a", 1.0, at(30.0, 30.0)), ("d", 1, 3, "c", 0.8, at(90.0, 90.0)), ("d", 1, 4, "lost", 0.9, at(500.0, 1.0))], "document_id string, page_number int, line_no int, text string, confidence double, bbox struct<x1:double,y1:double,x2:double,y2:double>")
    got = {(r["page_number"], r["region_index"]): (r["ocr_text"], r["ocr_confidence"], r["ocr_status"]) for r in matching.lines_to_regions(lines, regions).collect()}
    assert got == {(1, 0): ("c", 0.8, "done"), (1, 1): ("a\nb", 0.75, "done"), (1, 2): (None, None, "skipped"), (2, 0): ("", None, "done")}
    b = matching.band_count(regions).collect()
    assert {r["page_number"]: (r["eligible"], r["bands"]) for r in b} == {1: (2, 1), 2: (1, 1)}


def test_greedy_choices(spark):
    boxes = spark.createDataFrame([(1, 0, "a", 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, "a", 1.0, 1.0, 10.0, 10.0, 0.8), (1, 2, "b", 0.0, 0.0, 10.0, 10.0, 0.7), (1, 3, "a", 50.0, 0.0, 10.0, 10.0, 0.7)], "k int, pos int, class string, x double, y double, w double, h double, confidence double")
    assert {r["pos"] for r in matching.nms(boxes, ["k"]).collect()} == {0, 2, 3}
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 15.0, 15.0), (1, 2, 30.0, 30.0)], "k int, pos int, x double, y double")
    assert {r["pos"] for r in matching.dedupe_near(points, ["k"], ("x", "y"), 20.0).collect()} == {0, 2}
    assert {r["pos"] for r in matching.dedupe_near(points, ["k"], ("x", "y"), 20.0, "l2").collect()} == {0, 1, 2}


ENTITY = "document_id string, page_number int, pos int, id string, label string, printed_id string, stated_area string, linked boolean"
CANDIDATE = "document_id string, page_number int, pos int, region int, parcel int, label string, stated_area string, acres double, inset boolean, likely_duplicate boolean, n_calls int, roster_id string, deleted boolean"


def test_evidence_join(spark):
    entities = spark.createDataFrame([("d", 1, 0, "p1-x1", "PARCEL 1", None, "1.78 AC", False), ("d", 1, 1, "p1-x2", "REMAINDER", "17-2-1-4", "40.00 AC", False), ("d", 1, 2, "p1-x3", "LOT 9", None, None, True)], ENTITY)
    rows = [(0, "REMAINDER PARCEL", 40.1, False, False, 5, None, False), (1, "Parcel 1", 1.78, False, False, 4, None, False), (2, "", None, True, False, 4, None, False), (3, "LOT 77", None, False, False, 1, None, False), (4, "gone", 1.0, False, False, 4, None, True), (5, "LOT 8", 3.0, False, True, 4, None, False)]
    candidates = spark.createDataFrame([("d", 1, p, 0, p, label, str(a), a, i, dup, n, r, x) for p, label, a, i, dup, n, r, x in rows], CANDIDATE)
    got = {r["id"]: r for r in matching.join_evidence(entities, candidates).collect()}
    assert got["p1-x1"]["evidence_ref"]["parcel"] == 1 and got["p1-x2"]["evidence_ref"]["parcel"] == 0 and got["p1-x3"]["evidence_ref"] is None
    assert {r["label"]: r["excluded_reason"] for r in got.values() if r["source"] == "extraction"} == {"Parcel 4": "inset", "LOT 77": "too_few_calls", "LOT 8": "duplicate"}
    assert {i for i, r in got.items() if r["source"] == "extraction"} == {"p1-x4", "p1-x5", "p1-x6"}
    clash = spark.createDataFrame([("d", 1, 0, "LOT 1", 40.0)], "document_id string, page_number int, pos int, label string, acres double")
    far = entities.filter("pos = 0")
    assert matching.match_evidence(far, clash.withColumn("label", F.lit("X"))).count() == 0


def greedy(scored):
    """Pairs (score, entity, candidate) taken in turn, by trying all."""
    used, out = set(), set()
    for score, e, c in sorted(scored, key=lambda t: (-t[0], t[1], t[2])):
        if ("e", e) not in used and ("c", c) not in used:
            used |= {("e", e), ("c", c)}
            out.add((e, c, score))
    return out


def test_matches_are_those_of_all_pairs_in_turn(spark):
    rng = random.Random(8)
    label = lambda: rng.choice(["LOT 1", "PARCEL 1", "1 EAST", "LOT 2-A", "2-A WEST 1", "REMAINDER", "", None])
    size = lambda: rng.choice([None, 0.0, 97.0, 100.0, 90.0, 103.0, 110.0, 2.0, round(rng.uniform(80, 130), 2)])
    es = [(k, p, label(), rng.choice([None, None, "2-a", "1e"]), size()) for k in (1, 2, None) for p in range(25)]
    cs = [(k, p, label(), rng.choice([size(), size(), -5.0, float("nan")])) for k in (1, 2, None) for p in range(40)]
    e = spark.createDataFrame([(*r[:4], None if r[4] is None else f"{r[4]} AC") for r in es], "k int, pos int, label string, printed_id string, stated_area string")
    c = spark.createDataFrame(cs, "k int, pos int, label string, acres double")
    pairs = e.select("k", F.col("pos").alias("e"), F.struct("label", "printed_id", "stated_area").alias("x")).join(c.select("k", F.col("pos").alias("c"), F.struct("label", "acres").alias("y")), "k")
    scored = pairs.select("k", matching.match_score(F.col("x"), F.col("y")).alias("s"), "e", "c").filter("s is not null").collect()
    want = {(k, *m) for k in (1, 2) for m in greedy([tuple(r)[1:] for r in scored if r["k"] == k])}
    got = [tuple(r) for r in matching.match_evidence(e, c, ["k"]).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {s for *_, s in want} == {2, 3, 4, 5, 6}


def test_a_page_of_equal_labels_is_matched_without_its_pairs(spark):
    n = 6000
    e = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("pos"), F.lit("LOT 1").alias("label"), F.lit(None).cast("string").alias("printed_id"), F.lit("5 AC").alias("stated_area"))
    c = spark.range(n).select(F.lit(1).alias("k"), (2 * F.col("id")).alias("pos"), F.lit("LOT 1").alias("label"), F.lit(5.0).alias("acres"))
    got = matching.match_evidence(e, c, ["k"]).toPandas()
    assert len(got) == n and (got["candidate_pos"] == 2 * got["entity_pos"]).all() and (got["score"] == 6).all()


def test_first_within_is_the_least_of_all_pairs_at_any_end(spark):
    rng = random.Random(18)
    ends = [float(v) for a in (1.0, 7.3, 100.1, 2500.7) for x in (a - 0.05 * a, a + 0.05 * a, a) for v in (x, np.nextafter(x, 0), np.nextafter(x, 1e9))]
    value = lambda: rng.choice([None, -3.0, 0.0, float("nan"), float("inf"), *ends, *(rng.uniform(0.9, 3000) for _ in range(30))])
    left = [(k, i, a) for i in range(60) for k, a in [(rng.choice([1, 2, None]), rng.choice([1.0, 7.3, 100.1, 2500.7, value()]))]]
    right = [(rng.choice([1, 2, None]), p, value()) for p in rng.sample(range(500), 300)]
    fine = lambda v: v is not None and 0 < v < float("inf")
    want = {}
    for k, i, a in left:
        near = [p for m, p, b in right if k is not None and m == k and fine(a) and fine(b) and abs(a - b) <= 0.05 * a]
        want |= {i: min(near)} if near else {}
    got = matching.first_within(spark.createDataFrame(left, "k int, i int, a double"), spark.createDataFrame(right, "k int, p long, b double"), ["k"], "a", "b", 0.05, ["i"], "p")
    assert {tuple(r) for r in got.collect()} == set(want.items()) and len(want) > 20
    assert "Window" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and plan.count("Join") == 1  # only least rows of whole bins are joined


def test_rosters(spark):
    items = [(0, "PARCEL 1", "n/a", "1 ac"), (1, "parcel 1", "x", None), (2, " ", None, None), (3, "20' Access Easement", None, None), (4, "PARCEL 2", "38-1", None), (5, "REMAINDER", None, None)]
    df = spark.createDataFrame([("d", 1, *r) for r in items], "document_id string, page_number int, pos int, label string, printed_id string, stated_area string")
    got = sheets.sanitize_roster(df).orderBy("pos").collect()
    assert [(r["pos"], r["printed_id"]) for r in got] == [(0, None), (4, "38-1")]
    only = sheets.drop_non_parcels(df.filter("pos = 3"))
    assert only.count() == 1
    ids = sheets.entity_ids(df.filter("pos in (0, 4)"), spark.createDataFrame([("d", 1, "p1-x7")], "document_id string, page_number int, id string"))
    assert sorted(r["id"] for r in ids.collect()) == ["p1-x8", "p1-x9"]


def test_printed_ids_have_one_owner(spark):
    e = spark.createDataFrame([("d", 1, 0, "LOT A", "17-2"), ("d", 1, 1, "LOT 17-2", "17-2"), ("d", 1, 2, "LOT C", "99-9")], "document_id string, page_number int, pos int, label string, printed_id string")
    t = spark.createDataFrame([("d", 1, "plat of lot 17 - 2")], "document_id string, page_number int, sheet_text string")
    assert {r["pos"]: r["printed_id"] for r in matching.verify_printed_ids(e, t).collect()} == {0: None, 1: "17-2", 2: None}


def test_bearings_and_distances_are_paired(spark):
    rows = [(0, "N 45°00'00\" E", 0.9, 0.0, 0.0, 10.0, 10.0), (1, "100.50'", 0.8, 20.0, 0.0, 30.0, 10.0), (2, "200.00", 0.8, 1000.0, 0.0, 1010.0, 10.0), (3, "LOT 4", 0.8, 5.0, 5.0, 6.0, 6.0)]
    df = spark.createDataFrame([("d", *r) for r in rows], "k string, line_no int, text string, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = {r["text"]: (r["x1"], r["x2"], r["confidence"]) for r in matching.pair_split_bearings(df, ["k"]).collect()}
    assert got == {"N 45°00'00\" E 100.50'": (0.0, 30.0, 0.8), "200.00": (1000.0, 1010.0, 0.8), "LOT 4": (5.0, 6.0, 0.8)}


def test_coordinate_pairs_and_vertices(spark):
    rows = [(0, "N: 14,834,576.92", 0.0, 0.0, 100.0, 10.0), (1, "E: 2,289,281.05", 0.0, 12.0, 100.0, 22.0), (2, "PER THIS MAP", 0.0, -20.0, 90.0, -10.0), (3, "N 14834600.10", 2000.0, 0.0, 2100.0, 10.0), (4, "E 2289300.20", 2000.0, 12.0, 2100.0, 22.0), (5, "BRASS CAP", 2000.0, 25.0, 2090.0, 35.0), (6, "N 14834577.92", 5000.0, 0.0, 5100.0, 10.0)]
    df = spark.createDataFrame([("d", *r) for r in rows], "k string, line_no int, text string, x1 double, y1 double, x2 double, y2 double")
    pairs = matching.coordinate_pairs(df, ["k"])
    got = {r["n_line"]: (r["northing"], r["easting"], r["kind"]) for r in pairs.collect()}
    assert got == {0: (14_834_576.92, 2_289_281.05, "parcel_corner"), 3: (14_834_600.10, 2_289_300.20, "monument")}
    polygon = spark.createDataFrame([("d", [{"x": 60.0, "y": 0.0}, {"x": 900.0, "y": 0.0}, {"x": 900.0, "y": 700.0}])], f"k string, ring {RING}")
    assert {r["n_line"]: r["vertex"] for r in matching.bind_vertices(pairs, polygon, ["k"]).collect()} == {0: 0, 3: None}


def test_rings_of_ways(spark):
    p = lambda *v: [{"x": float(x), "y": float(y)} for x, y in v]
    ways = spark.createDataFrame([(1, 0, p((0, 0), (1, 0))), (1, 1, p((1, 1), (1, 0))), (1, 2, p((1, 1), (0, 0))), (2, 0, p((0, 0), (1, 0))), (2, 1, p((5, 5), (6, 6)))], f"relation_id long, pos int, points {RING}")
    got = {r["relation_id"]: r["ring"] for r in matching.ring_from_ways(ways).collect()}
    assert [tuple(v) for v in got[1]] == [(0, 0), (1, 0), (1, 1), (0, 0)] and got[2] is None


def test_carry_over_and_copies(spark):
    schema = "document_id string, page_number int, id string, label string, stated_area string, confirmed_polygon string, manual boolean"
    old = spark.createDataFrame([("d", 1, "a", "A", "1", "poly", False), ("d", 1, "m", "M", None, None, True), ("d", 1, "z", "Z", None, None, False), ("d", 2, "q", "Q", None, None, False)], schema)
    new = spark.createDataFrame([("d", 1, "a", "A2", None, None, False), ("d", 1, "b", "B", "2", None, False)], schema)
    got = {r["id"]: (r["label"], r["stated_area"], r["confirmed_polygon"]) for r in matching.carry_over(old, new).collect()}
    assert got == {"a": ("A2", "1", "poly"), "b": ("B", "2", None), "m": ("M", None, None), "q": ("Q", None, None)}
    copies = [(0, 9, "PARCEL A", 1.0, False, True, True), (1, 21, "PARCEL A PROPOSED", 1.05, True, True, True), (2, 21, "PARCEL B", 1.0, False, False, False), (3, 25, "PARCEL A", 9.0, False, False, False)]
    df = spark.createDataFrame([("d", *r) for r in copies], "document_id string, pos int, page_number int, label string, acres double, human_confirmed boolean, has_geometry boolean, has_validation boolean")
    assert {r["pos"] for r in matching.dedupe_copies(df).collect()} == {1, 2, 3}
    pairs = df.alias("a").crossJoin(df.alias("b")).filter("a.pos = 0 and b.pos in (1, 2, 3)")
    assert {r["pos"]: r["s"] for r in pairs.select(F.col("b.pos").alias("pos"), matching.same_parcel(F.col("a.label"), F.col("b.label"), F.col("a.acres"), F.col("b.acres")).alias("s")).collect()} == {1: True, 2: False, 3: False}


def test_duplicate_sheets_fold(spark):
    groups = spark.createDataFrame([("d", 9, False, True, 3, 10.0), ("d", 21, True, True, 3, 5.0), ("d", 23, False, True, 4, 50.0)], "document_id string, page_number int, confirmed boolean, primary boolean, n_refs int, area double")
    contained = spark.createDataFrame([("d", 9, 21), ("d", 21, 9), ("d", 9, 23)], "document_id string, inner_page int, outer_page int")
    assert {r["page_number"]: r["folded_under"] for r in sheets.collapse_duplicate_sheets(groups, contained).collect()} == {9: 21, 21: None, 23: None}
    regions = spark.createDataFrame([("d", 1, 0, False), ("d", 1, 1, True), ("d", 2, 0, False)], "document_id string, page_number int, region_index int, complete boolean")
    assert [r["suppressed"] for r in sheets.suppress_incomplete(regions).orderBy("page_number", "region_index").collect()] == [False, False, True]


FLAGS = "id string, human_confirmed boolean, awaiting_bind boolean, control_reading boolean, calibration_status string, placement_status string, shape_valid boolean, manual_position boolean, anchor_override boolean, aliquot_corroborated boolean, apn_corroborated boolean, control_validated boolean, apn_fit boolean, anchor_precision string"


def test_status_trees(spark):
    base = dict(human_confirmed=True, calibration_status="cross_validated", shape_valid=True, placement_status="surveyed_corner", anchor_precision="city")
    cases = {
        "Verified": {},
        "Confirming boundary…": {"awaiting_bind": True, "human_confirmed": False},
        "Boundary not confirmed": {"human_confirmed": False},
        "Refining placement…": {"control_reading": True, "placement_status": "approximate"},
        "Calibrating & placing…": {"calibration_status": "pending"},
        "Outline saved · not placed on the map": {"shape_valid": None},
        "Placed by hand": {"manual_position": True},
        "Placed by hand · check area": {"anchor_override": True, "shape_valid": False},
        "Unconfirmed placement": {"calibration_status": "unverified"},
        "Unconfirmed placement · no anchor": {"calibration_status": None},
        "Shape OK · location approx.": {"placement_status": "approximate"},
        "Needs review": {"shape_valid": False},
    }
    names = [c.split()[0] for c in FLAGS.split(", ")]
    df = spark.createDataFrame([tuple({**base, **over, "id": k}.get(n) for n in names) for k, over in cases.items()], FLAGS)
    assert all(r["id"] == r["v"] for r in df.select("id", status.verdict(F.struct(*names)).alias("v")).collect())
    gate = {r["id"]: (r["g"], r["p"]) for r in df.select("id", status.calibration_gate(F.struct(*names)).alias("g"), status.location_precision(F.struct(*names)).alias("p")).collect()}
    assert gate["Boundary not confirmed"][0] == "not_applicable" and gate["Placed by hand"][1] == "manual"
    w = spark.createDataFrame([(True, False, None, "u", False), (False, True, None, "u", False), (False, False, "u", "u", False), (False, False, "o", "u", False), (False, False, None, "u", True)], "s boolean, b boolean, o string, u string, a boolean").coalesce(1)
    assert [r["c"] for r in w.select(status.can_write(*(F.col(c) for c in "sboua")).alias("c")).collect()] == [False, True, True, False, True]


def xy(*points):
    return [{"x": x, "y": y} for x, y in points]


@pytest.fixture(scope="module")
def reported(spark):
    ring = xy((-119.8, 39.5), (-119.799, 39.5), (-119.799, 39.501), (-119.8, 39.501), (-119.8, 39.5))
    schema = "document_id string, " + FLAGS + f", ring {RING}, label string, apn string, review_status string, notes string, page_number int"
    row = lambda i, **k: tuple({**dict(document_id="d", id=i, human_confirmed=True, apn_corroborated=i == "a", ring=ring, label=f"LOT <{i}>", review_status="pending", notes="n" * 300, page_number=3), **k}.get(c.split()[0]) for c in ("document_id string, " + FLAGS + ", ring r, label s, apn s, review_status s, notes s, page_number i").split(", "))
    return report.build_report(spark.createDataFrame([row("a"), row("b"), row("c", human_confirmed=False), row("e", ring=ring[:2])], schema)).persist()


def test_report(spark, reported):
    rows = {r["id"]: r for r in reported.collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["placement_method"] == "apn" and rows["a"]["location_confirmed"] and not rows["b"]["location_confirmed"]
    assert rows["a"]["area_sqft"] * 0.09290304 == pytest.approx(85.96 * 111.0, rel=0.01)
    s = report.summarise(reported).first()
    assert (s["parcels"], s["confirmed"], s["approved"]) == (2, 1, 0)
    a = report.attribute_rows(reported).first()
    assert len(a.asDict()) == 21 and len(a["Notes"]) == 254 and a["APN"] == "" and all(len(c) <= 10 for c in a.asDict())
    assert report.vertex_rows(reported).count() == 10
    assert report.bounds(reported).first()["east"] == -119.799


def test_edits(spark, reported):
    rows = [("d", "parcel", "a", "label", "NEW", "me", 1), ("d", "parcel", "a", "label", "NEW", "me", 2), ("d", "parcel", "a", "review_status", "approved", "me", 3), ("d", "parcel", "a", "review_status", "maybe", "me", 4), ("d", "parcel", "a", "area", "5", "me", 5), ("d", "project", None, "title", "T", "me", 6)]
    e = spark.createDataFrame(rows, "document_id string, scope string, id string, field string, value string, editor string, at int")
    assert report.edit_log(e).count() == 3
    out = {r["id"]: (r["label"], r["review_status"]) for r in report.overlay(reported, e).collect()}
    assert out == {"a": ("NEW", "approved"), "b": ("LOT <b>", "pending")}


def test_documents_are_exported_whole(spark, reported):
    calls = spark.createDataFrame([("d", "a", [("N1°E", "5, ft"), ("S1°W", 'say "6"')])], "document_id string, id string, calls array<struct<bearing:string,distance:string>>")
    calls = calls.withColumn("calls", F.transform("calls", lambda c: F.struct(F.lit("line").alias("call_type"), c["bearing"].alias("bearing"), c["distance"].alias("distance"))))
    files = {k: exports.exported(reported, calls, k, "PRJ").collect() for k in exports.FORMATS}
    assert all(len(v) == 1 for v in files.values()) and files["kml"][0]["name"] == "d_kml.kml"
    lines = bytes(files["calls"][0]["content"]).decode("utf-8-sig").splitlines()
    assert len(lines) == 3 and "5, ft" in next(csv.reader([lines[1]])) and bytes(files["attributes"][0]["content"])[:3] == b"\xef\xbb\xbf"
    z = zipfile.ZipFile(io.BytesIO(bytes(files["package"][0]["content"])))
    assert sorted(z.namelist()) == sorted(f"d_{k}.{e}" for k, e in exports.FORMATS.items() if k != "package")
    assert len(json.loads(z.read("d_geojson.geojson"))["features"]) == 2 and "parcels.dbf" in zipfile.ZipFile(io.BytesIO(z.read("d_shapefile.zip"))).namelist()
    without = exports.exported(reported, calls, "package").first()
    assert "d_shapefile.zip" not in zipfile.ZipFile(io.BytesIO(bytes(without["content"]))).namelist()
    stem = spark.createDataFrame([(" a/b:c ",), ("",), ("x" * 90,)], "n string").select(exports.file_stem(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in stem] == ["a_b_c", "report", "x" * 60]
    with pytest.raises(ValueError):
        exports.exported(reported, calls, "poem")


def test_exports(spark, reported, tmp_path):
    c = json.loads(exports.geojson_collection(reported).first()["collection"])
    assert len(c["features"]) == 2 and c["features"][0]["geometry"]["coordinates"][0][0] == [-119.8, 39.5]
    k = exports.kml(reported).orderBy("id").first()["placemark"]
    assert "LOT &lt;a&gt;" in k and "-119.800000000,39.500000000,0" in k
    assert json.loads(exports.metadata(reported).first()["metadata"])["parcels"] == 2
    exports.write_csv(report.attribute_rows(reported), f"{tmp_path}/a")
    assert spark.read.csv(f"{tmp_path}/a", header=True).count() == 2
    data = exports.shapefile_zip([{"Label": "A", "CalcSF": 1.5, "ring": xy((0.0, 0.0), (1.0, 0.0), (1.0, 1.0))}], "PRJ")
    z = zipfile.ZipFile(io.BytesIO(data))
    shp = z.read("parcels.shp")
    assert struct.unpack(">i", shp[:4])[0] == 9994 and struct.unpack(">i", shp[24:28])[0] * 2 == len(shp)
    pts = [struct.unpack_from("<2d", shp, 100 + 8 + 48 + 16 * i) for i in range(4)]
    assert sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:])) < 0  # clockwise
    assert b"1.500" in z.read("parcels.dbf")


def test_command_folds(spark):
    e = spark.createDataFrame([("d", "p1", "propose", 1), ("d", "p1", "apply", 3), ("d", "p1", "discard", 4), ("d", "p2", "propose", 2), ("d", "p3", "propose", 2), ("d", "p3", "discard", 5)], "document_id string, proposal_id string, action string, ts int")
    assert {r["proposal_id"]: r["status"] for r in report.proposals(e).collect()} == {"p1": "applied", "p2": "pending", "p3": "discarded"}
    confirmations = spark.createDataFrame([("k", "c1", 1), ("k", "c2", 2)], "k string, confirmation_id string, ts int")
    results = spark.createDataFrame([("k", "c1", "old"), ("k", "c2", "new")], "k string, confirmation_id string, v string")
    assert [r["v"] for r in report.current_versions(results, confirmations, ["k"]).collect()] == ["new"]
    entities = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "id string, human_confirmed boolean")
    gone = spark.createDataFrame([("a",), ("b",)], "id string")
    assert {r["id"] for r in report.tombstoned(entities, gone, ["id"]).collect()} == {"a", "c"}
    moves = spark.createDataFrame([("d", 1, 10.0, 0.0), ("d", 1, 50.0, 0.0)], "document_id string, page_number int, east_m double, north_m double")
    checks = spark.createDataFrame([("d", 1, 11.0, 1.0, 1, True, 0.0, 9.0), ("d", 1, 10.5, 0.0, 2, False, 80.0, 1.0)], "document_id string, page_number int, east_m double, north_m double, seq int, corroborated boolean, hugging_pct double, overlap_pct double")
    assert [(r["east_m"], r["strong"]) for r in report.checked_proposals(moves, checks).collect()] == [(10.0, True)]


def test_quality(spark):
    df = spark.createDataFrame([(1, 91.0, 0.0, None), (2, 1.0, -181.0, 7.0), (3, 1.0, 1.0, 5.0), (4, None, 1.0, 1.0)], "k int, latitude double, longitude double, rating double").coalesce(1)
    assert [r["violations"] for r in quality.with_violations(df).collect()] == [["latitude"], ["longitude", "rating"], [], ["latitude"]]
    assert {r["name"]: r["returns"] for r in quality.tool_specs(spark).collect()}["cogo_azimuth"] == "double"
    with pytest.raises(KeyError):
        quality.call(df, "nothing", "k", "v")
    r = spark.range(1).select(quality.rate(F.lit(1), F.lit(3)).alias("a"), quality.rate(F.lit(1), F.lit(0)).alias("b"), quality.coerce_number(F.lit("1,200")).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (0.333, None, 1200.0)


def test_results_become_tables(spark, tmp_path):
    doc = {"document_id": "d", "pages": [{"page_number": 1, "width": 10.0, "sheet": {"main_region": 0, "parcels": [{"id": "p1-x1", "label": "LOT 1"}]}, "regions": [{"class": "ParcelMap", "confidence": 0.9, "bbox": {"x": 0, "y": 0, "w": 1, "h": 1}, "parcels": [{"roster_id": None, "vision_geometry": {"parcel_label": "LOT 1", "boundary_calls": [{"bearing": "N0E", "distance": "1"}, {"bearing": "N1E", "distance": "2"}]}}]}]}]}
    (tmp_path / "result.json").write_text(json.dumps(doc, indent=1))
    r = tables.read_results(spark, str(tmp_path))
    assert tables.pages(r).count() == 1 and tables.regions(r).first()["class"] == "ParcelMap" and tables.entities(r).first()["label"] == "LOT 1"
    assert [c["bearing"] for c in tables.calls(r).orderBy("seq").collect()] == ["N0E", "N1E"]
    assert tables.read_results(spark, str(tmp_path / "missing")).count() == 0
    hits = spark.createDataFrame([("k", " me ", "", [[1.0], [1.0, 2.0]]), ("t", None, None, [[1.0]]), ("t", None, None, [[1.0]])], "apn string, owner string, address string, rings array<array<double>>")
    one = tables.single_feature(hits, "apn").collect()
    assert [(r["apn"], r["owner"], r["address"], r["ring"]) for r in one] == [("k", "me", None, [1.0, 2.0])]


# streams


def test_streams_agree_with_batches(spark, tmp_path):
    import pandas as pd

    rows = [(f"d{i % 3}", pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=40 * i), progress.STAGES[i % 9]) for i in range(60)]
    events = spark.createDataFrame(pd.DataFrame(rows, columns=["document_id", "ts", "stage"]))
    events.repartition(3).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    last = run(progress.stream_progress(stream), "update", "stage_stream").groupBy("document_id").agg(F.max_by("stage", "updates").alias("stage"), F.max("updates").alias("n"))
    batch = progress.current_progress(events.withColumn("detail", F.lit("")).withColumn("error", F.lit(None).cast("string")))
    assert {(r["document_id"], r["stage"], r["n"]) for r in last.collect()} == {(r["document_id"], r["stage"], len(r["history"])) for r in batch.collect()}
    counts = run(progress.stream_counts(stream, "ts", "document_id", "10 minutes", late="2 days"), "complete", "count_stream")
    want = events.groupBy(F.window("ts", "10 minutes").alias("w"), "document_id").count()
    assert {(r["start"], r["document_id"], r["n"]) for r in counts.collect()} == {(r["w"]["start"], r["document_id"], r["count"]) for r in want.collect()}


def test_windows_over_time(spark):
    rows = [(i, "k", float(t), 60_000) for i, t in enumerate([0, 10, 20, 60, 70, 500])]
    df = spark.createDataFrame(rows, "event_id int, k string, t double, tokens int").withColumn("ts", F.timestamp_seconds("t"))
    assert [r["in_window"] for r in progress.rate_window(df, ["k"], "ts", 60, 3).orderBy("event_id").collect()] == [1, 2, 3, 4, 4, 1]
    assert [r["allowed"] for r in progress.token_window(df.withColumn("tokens", F.lit(200_000)), ["k"], "ts", "tokens", 60, 180_000).orderBy("event_id").collect()] == [True, False, False, False, False, True]
    assert progress.sessions(df, ["k"], "ts", 100).count() == 2
    assert [r["event_id"] for r in progress.throttled_touches(df, ["k"], "ts", 30).orderBy("event_id").collect()] == [0, 3, 5]
    assert G.XY.startswith("array")


def test_nearest_edges_are_those_of_all_pairs(spark, monkeypatch):
    """Points and edges of a key are dealt out; neither is compared with all of the other."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(matching, "_EDGES", 7)
    monkeypatch.setattr(matching, "_POINTS", 5)
    p = [(k % 3, k, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(-20, 20, (60, 2)))] + [(1, 60, None, 2.0)]
    e = [(k % 3, k, *map(float, v)) for k, v in enumerate(rng.integers(-20, 20, (50, 4)))] + [(2, 50, 1.0, 1.0, 1.0, 1.0), (2, 51, 1.0, None, 1.0, 1.0)]
    points = spark.createDataFrame(p, "page int, point int, px double, py double")
    edges = spark.createDataFrame(e, "page int, edge_index int, ax double, ay double, bx double, by double")
    got = {r["point"]: (r["distance"], r["edge_index"]) for r in matching.nearest_edge(points, edges, ["page"]).collect()}
    far = G.point_segment_distance(*(F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")))
    pairs = points.dropna().join(edges.dropna(), "page").select("point", "edge_index", far.alias("d")).toPandas()
    least = pairs.groupby("point")["d"].min()
    assert set(got) == set(range(61)) and got[60] == (None, 1)
    for k, d in least.items():
        assert got[k][0] == pytest.approx(d)
        assert got[k][1] in set(pairs[(pairs["point"] == k) & (pairs["d"] < d + 1e-9)]["edge_index"])


def test_a_point_looks_into_few_blocks():
    n = 40_000
    at = np.arange(n, dtype=float)
    edges = np.column_stack([at, np.zeros(n), at, np.zeros(n)])
    start = time.time()
    distance, index = matching._nearest(np.column_stack([at + 0.25, np.ones(n)]), edges, np.arange(n))
    assert (index == np.arange(n)).all() and time.time() - start < 30


def test_nms_leaves_classes_apart(spark):
    """Groups are one class of a page: they share the work, and a large page is no quadratic frame."""
    rng = np.random.default_rng(6)
    rows = [("p", int(k), rng.choice(["a", "b", None]), float(rng.integers(0, 30)), float(rng.integers(0, 30)), 10.0, 10.0, float(rng.random())) for k in range(150)]
    boxes = spark.createDataFrame([(r[0], r[1], None if r[2] is None else str(r[2]), *r[3:]) for r in rows], "page string, pos long, class string, x double, y double, w double, h double, confidence double")
    kept = {}
    for r in sorted(rows, key=lambda r: (-r[7], r[1])):
        def over(q):
            i = max(0, min(q[3], r[3]) + 10 - max(q[3], r[3])) * max(0, min(q[4], r[4]) + 10 - max(q[4], r[4]))
            return i / (200 - i) >= 0.6
        if not any(q[2] == r[2] and over(q) for q in kept.values()):
            kept[r[1]] = r
    out = matching.nms(boxes, ["page"])
    assert {r["pos"] for r in out.collect()} == set(kept)
    assert "class" in out._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInPandas")[1][:40]


def test_lines_meet_the_smallest_boxes_only(spark):
    """Of boxes that lie on each other a cell keeps the smallest that covers it and those that cover a part; the smallest of all pairs is still found."""
    rng = np.random.default_rng(8)
    boxes = [("d", 1, k, "Text", {"x": float(x), "y": float(y), "w": float(w), "h": float(h)}) for k, (x, y, w, h) in enumerate(np.column_stack([rng.integers(0, 40, (400, 2)), rng.integers(0, 60, (400, 2))]))]
    lines = [("d", 1, k, f"t{k}", 0.5, {"x1": float(x), "y1": float(y), "x2": float(x), "y2": float(y)}) for k, (x, y) in enumerate(rng.integers(-5, 110, (300, 2)) / 2)]
    regions = spark.createDataFrame(boxes, f"document_id string, page_number int, region_index int, class string, bbox {BOX}").withColumns({"ocr_text": F.lit(None).cast("string"), "ocr_confidence": F.lit(None).cast("double")})
    df = spark.createDataFrame(lines, "document_id string, page_number int, line_no int, text string, confidence double, bbox struct<x1:double,y1:double,x2:double,y2:double>")
    got = {t: r["region_index"] for r in matching.lines_to_regions(df, regions).collect() for t in (r["ocr_text"] or "").split("\n") if t}
    want = {}
    for _, _, k, t, _, p in lines:
        held = [(b["w"] * b["h"], i) for _, _, i, _, b in boxes if b["x"] <= p["x1"] <= b["x"] + b["w"] and b["y"] <= p["y1"] <= b["y"] + b["h"]]
        if held:
            want[t] = min(held)[1]
    assert got == want
    stacked = spark.range(2000).selectExpr("'d' as document_id", "1 as page_number", "id as region_index", "named_struct('x', 0D, 'y', 0D, 'w', 33D + id % 7, 'h', 33D + id % 7) as bbox")
    filed, _ = matching.box_cells(stacked, df.selectExpr("document_id", "page_number", "1D as cx", "1D as cy"))
    assert filed.filter("_gx = 0 and _gy = 0").count() == 1
