import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators import cogo, matching, regionflow, search, sheets

FIELDS = "parcel_key string, seq int, call_type string, bearing string, distance string, delta string, radius string, arc_length string, turn string, start_tangent_bearing string"


def line(b, d):
    return {"bearing": b, "distance": d}


SQUARE = [line("N 0°00'00\" E", "100'"), line("N 90°00'00\" E", "100'"), line("S 0°00'00\" E", "100'"), line("S 90°00'00\" W", "100'")]
PARCEL_1 = [line("S89°24'39\"E", "1318.25"), line("S0°48'45\"W", "1320.11"), line("N89°33'00\"W", "1318.27"), line("N0°48'45\"E", "1323.32")]


def frame(spark, parcels):
    rows = [(k, i, c.get("call_type", "line"), *(c.get(f) for f in cogo.CALL_FIELDS[1:])) for k, calls in parcels.items() for i, c in enumerate(calls)]
    return spark.createDataFrame(rows, FIELDS)


def walks(spark, parcels):
    return {r["parcel_key"]: r for r in cogo.validate(cogo.walk_traverse(frame(spark, parcels), ["parcel_key"])).collect()}


def test_closed_square(spark):
    w = walks(spark, {"a": SQUARE, "b": [*SQUARE[:3], line("null", "5"), line("rubbish", "7")]})
    assert w["a"]["closure_error_ft"] == 0 and w["a"]["area_sqft"] == 10_000 and w["a"]["perimeter_ft"] == 400 and w["a"]["valid"] and w["a"]["precision_ratio"] is None
    assert w["b"]["unparsed_calls"] == 1 and w["b"]["closure_error_ft"] == 100 and w["b"]["issues"] == ["weak_closure"]


def test_figure_eight_crosses(spark):
    eight = [line("N45E", "100"), line("N0E", "10"), line("S45E", "100"), line("N0E", "10"), line("S45W", "50")]
    bow = [line("N45°E", "141.42"), line("S0°E", "100"), line("N45°W", "141.42"), line("S0°E", "100")]
    w = walks(spark, {"bow": bow, "eight": eight})
    assert w["bow"]["self_intersects"] and (w["bow"]["crossing"]["i"], w["bow"]["crossing"]["j"]) == (0, 2)


def test_curve_takes_the_tangent_and_its_segment(spark):
    curve = {"call_type": "curve", "delta": "90°", "radius": "100", "arc_length": "157.08", "turn": "R"}
    w = walks(spark, {"r": [line("N0E", "100"), curve, line("S0E", "200"), line("S90W", "100")], "l": [line("N0E", "1"), {**curve, "turn": "l"}], "t": [{**curve, "start_tangent_bearing": "N0E"}], "none": [curve], "zero": [line("N0E", "1"), {**curve, "radius": "0"}]})
    end = w["r"]["points"][2]
    assert (round(end["x"], 6), round(end["y"], 6)) == (100, 200)
    c = w["r"]["curves"][0]
    segment = 0.5 * 100**2 * (math.pi / 2 - 1)
    assert c["signed_segment_area_sqft"] == pytest.approx(-segment, abs=1e-3) and c["tangent_out_azimuth"] == 90 and c["arc_length_mismatch_ft"] == 0
    assert w["l"]["curves"][0]["signed_segment_area_sqft"] > 0 and round(w["l"]["points"][2]["x"], 6) == -100
    assert len(w["t"]["points"]) == 2 and w["t"]["curves"][0]["used_explicit_start_tangent"]
    assert w["none"]["unparsed_calls"] == 1 and w["zero"]["unparsed_calls"] == 1


def test_merge_curve_calls(spark):
    lines = spark.createDataFrame([("a", 0, "N0E", "1"), ("a", 1, "N90E", "2")], "k string, seq int, bearing string, distance string")
    curves = spark.createDataFrame([("a", 0, 0, "10°", "5"), ("a", 1, -1, "20°", "6"), ("a", 2, 7, "30°", "7"), ("a", 3, None, "40°", "8")], "k string, pos int, after_call_index int, delta string, radius string")
    got = cogo.merge_curve_calls(lines, curves, ["k"]).orderBy("seq").collect()
    assert [(r["call_type"], r["distance"] or r["delta"]) for r in got] == [("curve", "20°"), ("line", "1"), ("curve", "10°"), ("line", "2")]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 359), st.integers(1, 500)), min_size=1, max_size=9), min_size=1, max_size=6))
def test_walk_equals_python(spark, parcels):
    def text(a):
        q, ns, ew = (a, "N", "E") if a <= 90 else (180 - a, "S", "E") if a <= 180 else (a - 180, "S", "W") if a <= 270 else (360 - a, "N", "W")
        return f"{ns} {q}°00'00\" {ew}"

    made = {str(i): [line(text(a), str(d)) for a, d in p] for i, p in enumerate(parcels)}
    for k, w in walks(spark, made).items():
        pts = search.points(made[k])
        assert w["closure_error_ft"] == pytest.approx(search.closure(pts), abs=0.011)
        assert [(p["x"], p["y"]) for p in w["points"]] == [pytest.approx(tuple(p), abs=1e-6) for p in pts.tolist()]


def test_ring_measures_are_invariant(spark):
    rng = random.Random(1)
    ring = [(rng.random() * 50, rng.random() * 50) for _ in range(7)]
    turn = lambda p, a, dx: (p[0] * math.cos(a) - p[1] * math.sin(a) + dx, p[0] * math.sin(a) + p[1] * math.cos(a) - dx)
    variants = [ring, ring[::-1], ring[3:] + ring[:3], [turn(p, 1.1, 300) for p in ring], ring + ring[:1]]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in v],) for v in variants], "ring array<struct<x:double,y:double>>")
    areas = [r["a"] for r in df.select(G.ring_area(F.col("ring")).alias("a")).collect()]
    assert areas == [pytest.approx(areas[0])] * 5
    unit = spark.createDataFrame([([{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 3.0}],)], "ring array<struct<x:double,y:double>>")
    r = unit.select(G.signed_area(F.col("ring")).alias("s"), G.path_length(F.col("ring")).alias("p"), G.contains(F.col("ring"), F.lit(3.0), F.lit(1.0)).alias("i"), G.contains(F.col("ring"), F.lit(1.0), F.lit(2.0)).alias("o"), G.covers(F.col("ring"), F.lit(2.0), F.lit(0.0)).alias("e"), G.vertex_mean(F.col("ring")).alias("m")).first()
    assert (r["s"], r["p"], r["i"], r["o"], r["e"]) == (6.0, 7.0, True, False, True) and round(r["m"]["x"], 6) == round(8 / 3, 6)


# repairs


def test_ambiguous_reading_is_resolved_by_area():
    calls = [line("N0E", "903.15"), line("N90E", "220.00"), line("S0E", "903.15"), line("S90W", "220.00")]
    alternates = [line("N0E", "352.40")]
    got = search.resolve_ambiguous(calls, alternates, 1.78 * 43_560, [2.78 * 43_560])
    assert [c["distance"] for c in got] == ["352.40", "220.00", "352.40", "220.00"]
    assert round(search.area(search.points(got)), 1) == 77_528.0
    assert search.resolve_ambiguous(calls, [], 5.0) == calls


def test_conflicting_duplicate_is_dropped():
    calls = [line("N0E", "2417.36"), line("N0E", "2637.36"), line("N90E", "100"), line("S0E", "2417.36"), line("S90W", "100")]
    got = search.drop_conflicting(calls)
    assert len(got) == 4 and search.closure(search.points(got)) < 1
    assert search.drop_conflicting(SQUARE) == SQUARE


def test_assembly_turns_orders_and_drops():
    true = search.area(search.points(PARCEL_1))
    turned = [{**c, "bearing": search.reversed_bearing(c["bearing"])} if k in (1, 2) else c for k, c in enumerate(PARCEL_1)]
    got, notes = search.assemble(turned)
    assert search.closure(search.points(got)) < 5 and search.area(search.points(got)) == pytest.approx(true, rel=0.01) and len(notes) == 1
    shuffled, notes = search.assemble([PARCEL_1[0], PARCEL_1[2], PARCEL_1[1], PARCEL_1[3]])
    assert len(shuffled) == 4
    extra = [*SQUARE, line("N45E", "70")]
    assert search.assemble(extra)[0] == extra  # dropping needs a stated area
    fixed, notes = search.assemble(extra, 10_000.0)
    assert len(fixed) == 4 and any("left out" in n for n in notes)
    assert search.assemble(SQUARE) == (SQUARE, [])


def test_borrowing_needs_the_own_area():
    short = SQUARE[:3]
    got, note = search.borrow(short, 10_000.0, [("LOT 2", [line("N90E", "100")])], [])
    assert len(got) == 4 and got[3]["bearing"].startswith("S") and "LOT 2" in note
    assert search.borrow(short, 10_000.0, [("LOT 2", [line("N90E", "100")])], [10_100.0]) == (short, None)
    assert search.borrow(SQUARE, 10_000.0, [("x", SQUARE)], []) == (SQUARE, None)


def test_outlier_call(spark):
    v = [("a", i, float(a), d) for i, (a, d) in enumerate([(0, 100.0), (90, 100.0), (180, 100.0), (270, 100.0), (45, 300.0)])] + [("b", i, 0.0, 1.0) for i in range(3)]
    df = spark.createDataFrame(v, "k string, seq int, azimuth double, distance double")
    rows = cogo.outlier_calls(df, ["k"], ["seq"]).collect()
    assert [(r["k"], r["call_index"], r["baseline_closure_ft"], r["closure_without_ft"], r["improvement"]) for r in rows] == [("a", 4, 300.0, 0.0, 1.0)]


def test_shared_edge_and_alignment(spark):
    remainder = [line("N89°33'00\"W", "3946.91"), line("N0°48'45\"E", "1333.30"), line("S89°24'39\"E", "3950.22"), line("S0°48'45\"W", "1323.32")]
    lots = [line("N0E", "300"), line("N90E", "300"), line("S0E", "300"), line("S90W", "300")], [line("N0E", "500"), line("N90E", "500"), line("S0E", "500"), line("S90W", "500")]
    parcels = {("d", 1, 0, 0): PARCEL_1, ("d", 1, 0, 1): remainder, ("d", 1, 1, 0): lots[0], ("d", 1, 1, 1): lots[1]}
    rows = [(*k, [{"x": float(x), "y": float(y)} for x, y in search.points(c)]) for k, c in parcels.items()]
    df = spark.createDataFrame(rows, "document_id string, page_number int, region_index int, parcel_index int, points array<struct<x:double,y:double>>")
    got = {(r["region_index"], r["parcel_index"]): r for r in regionflow.resolve_shared_edges(df).collect()}
    assert got[0, 1]["aligned"] and not got[1, 1]["aligned"] and not got[0, 0]["aligned"]
    p, q = got[0, 0]["points"], got[0, 1]["points"]
    ends = [(p[3]["x"], p[3]["y"]), (p[4]["x"], p[4]["y"])]
    assert min(math.dist(ends[0], (v["x"], v["y"])) for v in q) < 10 and min(math.dist(ends[1], (v["x"], v["y"])) for v in q) < 10


def test_region_flow(spark):
    call = "array<struct<bearing:string,distance:string>>"
    turned = [SQUARE[0], {**SQUARE[1], "bearing": "S90°00'00\"W"}, SQUARE[2], {**SQUARE[3], "bearing": "N90°00'00\"E"}]
    rows = [("d", 1, 0, 0, "A", SQUARE, [], "0.2296", "", 39.5, -119.8), ("d", 1, 0, 1, "B", turned, [], "0.2296", "", 39.5, -119.8), ("d", 1, 0, 2, "C", SQUARE[:3], [], "0.2296", "", 39.5, -119.8), ("d", 1, 1, 0, "D", SQUARE, [], None, "CONTAINING 0.9 ACRES", None, None)]
    df = spark.createDataFrame(rows, f"document_id string, page_number int, region_index int, parcel_index int, label string, calls {call}, alternates {call}, stated_area_acres string, region_text string, anchor_lat double, anchor_lon double")
    got = {(r["region_index"], r["parcel_index"]): r for r in regionflow.walk_region_parcels(df).collect()}
    assert got[0, 0]["valid"] and got[0, 1]["valid"] and not got[0, 2]["valid"]  # C's area is a sibling's too
    assert got[0, 0]["ring_wgs84"][0] == got[0, 0]["ring_wgs84"][-1] and got[0, 0]["ring_wgs84"][0]["x"] == pytest.approx(-119.8)
    assert got[1, 0]["stated_area_sqft"] == pytest.approx(0.9 * 43_560) and got[1, 0]["issues"] == ["area_mismatch"]
    again = regionflow.recompute(df, auto_fix=True).collect()
    assert sum(r["valid"] for r in again) >= 2


def test_chunks_and_tiles(spark):
    items = spark.createDataFrame([("d", i, t) for i, t in enumerate([50, 60, 30, 500, 10, 90])], "k string, pos int, tokens int")
    got = {r["pos"]: r["chunk"] for r in sheets.chunk_by_budget(items, ["k"], 100).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: 3}
    pages = spark.createDataFrame([("d", 1, 1300, 700)], "document_id string, page_number int, width int, height int")
    tiled = sheets.tiles(pages, 700, 100)
    assert sorted((r["tx"], r["ty"]) for r in tiled.collect()) == [(x, y) for x in (0, 600, 1200) for y in (0, 600)]
    near = sheets.tiles_near(tiled, spark.createDataFrame([("d", 1, 50.0, 50.0)], "document_id string, page_number int, px double, py double"), 10.0, 700)
    assert [(r["tx"], r["ty"]) for r in near.collect()] == [(0, 0)]
    assert matching.OCR_CLASSES[0] == "Text"
