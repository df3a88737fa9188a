import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import geodesy as E
from plumbline.functions import geometry as G
from plumbline.operators import fill, moves, outline, placement, trials

RING = "array<struct<x:double,y:double>>"


def xy(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def test_projections_round_trip():
    rng = np.random.default_rng(1)
    for z in (*E.ZONES, E.utm(32611), E.utm(32743)):
        w, s, e, n = z.bounds if z.epsg < 32600 else (z.lon0 - 3, -20.0, z.lon0 + 3, 60.0)
        lon, lat = rng.uniform(w, e, 200), rng.uniform(s, n, 200)
        lon2, lat2 = E.inverse(z, *E.forward(z, lon, lat))
        assert np.abs(lon2 - lon).max() < 1e-10 and np.abs(lat2 - lat).max() < 1e-10


def test_ground_coordinates_land_where_the_sheet_says():
    east, north, factor = 2_289_281.05, 14_834_576.92, 1.000197939
    lon, lat = E.inverse(E.BY_EPSG[3423], np.array([east / factor]), np.array([north / factor]))
    assert lat[0] == pytest.approx(39.4362, abs=0.002) and lon[0] == pytest.approx(-119.7724, abs=0.002)
    far = E.inverse(E.BY_EPSG[3423], np.array([east]), np.array([north]))
    gap = G.M_PER_DEG_LAT * math.hypot((far[0][0] - lon[0]) * math.cos(math.radians(39.4)), far[1][0] - lat[0])
    assert 800 < gap < 1000


def test_utm_scale_and_origin():
    x, y = E.forward(E.utm(32631), np.array([3.0, 3.0]), np.array([0.0, 45.0]))
    assert x.tolist() == [pytest.approx(500_000)] * 2 and y[0] == pytest.approx(0, abs=1e-6)
    assert y[1] == pytest.approx(4_982_950.400, abs=0.01)  # meridian arc to 45 degrees, 4 984 944.378 m, by 0.9996


def test_geodesics():
    lon, lat = E.direct(np.array([-119.0]), np.array([39.0]), np.array([0.0]), np.array([1000.0]))
    assert lon[0] == pytest.approx(-119.0) and (lat[0] - 39) * 111_015 == pytest.approx(1000, rel=2e-4)
    lon, lat = E.direct(np.array([0.0]), np.array([0.0]), np.array([90.0]), np.array([E.A * math.pi / 180]))
    assert lon[0] == pytest.approx(1.0, abs=1e-9) and lat[0] == pytest.approx(0)
    square = np.array([0.0, 0.01, 0.01, 0.0]), np.array([0.0, 0.0, 0.01, 0.01])
    assert E.geodesic_area_m2(*square) == pytest.approx(1113.1949 * 1105.7427, rel=1e-4)


def test_rings_on_the_ground(spark):
    df = spark.createDataFrame([(xy([(0, 0), (0, 100), (100, 100)]), -119.8, 39.5)], f"ring {RING}, lon double, lat double")
    r = df.select(E.local_ring_to_lonlat("ring", "lon", "lat").alias("r"), E.ring_from_ground_corner("ring", F.lit(0), F.lit(14_834_576.92), F.lit(2_289_281.05), F.lit(3423), F.lit(1.000197939)).alias("g")).first()
    assert r["r"][0] == r["r"][-1] and (r["r"][1]["y"] - 39.5) * 111_000 == pytest.approx(30.48, abs=0.2)
    x, y = E.forward(E.BY_EPSG[3423], np.array([r["g"][0]["x"]]), np.array([r["g"][0]["y"]]))
    assert x[0] * 1.000197939 == pytest.approx(2_289_281.05, abs=0.05) and y[0] * 1.000197939 == pytest.approx(14_834_576.92, abs=0.05)
    moved = df.select(E.shift_ring("ring", F.lit(0.0), F.lit(0.0)).alias("m")).first()["m"]
    assert [tuple(p) for p in moved] == [(0.0, 0.0), (0.0, 100.0), (100.0, 100.0)]
    m = spark.createDataFrame([(xy([(3.0, 45.0), (3.001, 45.0), (3.001, 45.001), (3.0, 45.001)]),)], f"ring {RING}").select(E.projected_measures("ring", F.lit(32631)).alias("m"), E.area_km2("ring").alias("k")).first()
    assert m["m"]["area_sqft"] * 0.09290304 / 1e6 == pytest.approx(m["k"], rel=2e-3)


# county parcels

LAT, LON = 39.6, -119.8


def rect(x, y, w, h):
    k = (G.M_PER_DEG_LON * math.cos(math.radians(LAT)), G.M_PER_DEG_LAT)
    return np.array([(LON + a / k[0], LAT + b / k[1]) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))])


def test_group_is_seated_in_its_gap():
    around = [rect(-60, 0, 60, 50), rect(90, 0, 60, 50), rect(-60, 50, 105, 40), rect(45, 50, 105, 40), rect(-60, -40, 105, 40), rect(45, -40, 105, 40)]
    lots = [rect(30 * k - 40, 25, 30, 50) for k in range(3)]
    fit = placement.placement_by_apn(lots, around, None)
    assert fit["mode"] == "between_neighbours" and fit["corroborated"]
    assert fit["east_m"] == pytest.approx(40, abs=1) and fit["north_m"] == pytest.approx(-25, abs=1) and fit["rotation_deg"] == 0


def test_sliding_row_is_not_corroborated():
    row = [rect(30 * k, 60, 30, 50) for k in range(-17, 17)]
    fit = placement.placement_by_apn([rect(0, 0, 30, 50)], row, None)
    assert not fit["corroborated"]


def test_target_parcel_decides_if_areas_agree():
    lots = [rect(-90, 10, 30, 50), rect(-60, 10, 30, 50)]
    fit = placement.placement_by_apn(lots, [], rect(0, 0, 60, 50))
    assert fit["mode"] == "target_parcel" and fit["corroborated"]
    assert fit["east_m"] == pytest.approx(90, abs=1) and fit["north_m"] == pytest.approx(-10, abs=1)
    assert placement.placement_by_apn(lots, [], rect(0, 0, 300, 300))["mode"] == "between_neighbours"
    assert placement.placement_by_apn(lots, [], None) is None


def test_turn_is_undone():
    quad = np.array([(0.0, 0.0), (140.0, 10.0), (120.0, 90.0), (10.0, 60.0)])
    turned = placement._rotate(quad, 60, placement._centroid(quad)) + (1000, 500)
    fit = placement.onto_target([turned], quad)
    assert fit["rotation_deg"] == pytest.approx(-60, abs=0.5) and fit["overlap"] > 0.999


def test_fits_and_evaluations_as_tables(spark):
    around = [rect(-60, 0, 60, 50), rect(30, 0, 60, 50), rect(-60, 50, 150, 40), rect(-60, -40, 150, 40)]
    row = (1, [xy(rect(0, 300, 30, 50))], [xy(r) for r in around], None, 0.0, -300.0, 0.0)
    df = spark.createDataFrame([row, (2, *row[1:4], 0.0, 0.0, 0.0)], f"k int, rings array<{RING}>, neighbours array<{RING}>, target {RING}, east_m double, north_m double, rotation_deg double")
    got = {r["k"]: r for r in moves.evaluate_positions(df, ["k"]).collect()}
    assert got[1]["hugging_pct"] > 90 and got[1]["overlap_pct"] < 1
    assert got[2]["hugging_pct"] == 0 and got[2]["nearest_edge_m"] > 200
    near = moves.search_near(df.filter("k = 1"), ["k"]).first()
    assert near["total_north_m"] == pytest.approx(-300, abs=2) and near["corroborated"]
    text = spark.range(1).select(moves.direction_text(F.lit(-3.0), F.lit(12.2)).alias("t"), moves.direction_text(F.lit(0.1), F.lit(0.2)).alias("n")).first()
    assert (text["t"], text["n"]) == ("12 m north, 3 m west", "")


# calibration


def test_calibration_statuses(spark):
    ring = [(0, 0), (1000, 0), (1000, -500), (0, -500)]
    scale = 0.5
    edges = {0: (90.0, 500.0), 1: (0.0, 250.0), 2: (270.0, 500.0), 3: (180.0, 250.0)}

    def cands(items):
        return [("p", e, edges[e][1] * f, az, edges[e][1] / scale, edges[e][0]) for e, f, az in items]

    cases = {
        "cross": [(0, 1.0, 92.0), (1, 1.01, 2.0), (2, 1.0, None)],
        "single": [(0, 1.0, 92.0), (1, 1.0, None)],
        "far": [(0, 1.0, 130.0), (1, 1.0, None)],
        "scale": [(0, 1.1, 92.0), (1, 1.1, 2.0)],
        "spread": [(0, 1.0, 92.0), (1, 1.0, 30.0)],
        "none": [],
    }
    local = lambda rot: [(x * scale, -y * scale) for x, y in ring] if not rot else None
    parcels = spark.createDataFrame([(k, xy(ring), 125_000.0, xy(local(0)), {"x": 0.0, "y": 0.0}, {"x": 0.0, "y": 0.0}) for k in cases], f"k string, ring {RING}, stated_area_sqft double, old_ring {RING}, page_pivot struct<x:double,y:double>, local_pivot struct<x:double,y:double>")
    found = [(k, *c[1:]) for k, items in cases.items() for c in cands(items)]
    df = spark.createDataFrame(found, "k string, edge_index int, value double, azimuth double, length_px double, angle_px double")
    got = {r["k"]: r for r in placement.calibrate(df, parcels, ["k"]).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"cross": "cross_validated", "single": "single_source", "far": "unverified", "scale": "unverified", "spread": "unverified", "none": "unverified"}
    assert got["cross"]["rotation_deg"] == pytest.approx(2.0) and got["cross"]["scale_ft_per_px"] == pytest.approx(scale) and got["cross"]["corroborating_edge_count"] == 3
    assert got["scale"]["scale_ft_per_px"] is None and got["far"]["scale_ft_per_px"] == pytest.approx(scale)


def test_quadrant_letters():
    edge = np.array([1, 3, 6])
    chosen, flipped = placement.quadrant_consensus(edge, np.array([40.0, 40.5, 137.6]), np.array([100.0, 99.0, 40.2]))
    assert flipped.tolist() == [False, False, True] and np.abs(chosen - 40).max() < 1
    assert placement.quadrant_consensus(np.array([1, 2]), np.array([10.0, 60.0]), np.array([120.0, 90.0]))[0] is None
    rng, false = np.random.default_rng(1), 0
    for _ in range(4000):
        r, a = rng.uniform(0, 180, 2), rng.uniform(0, 180, 2)
        false += placement.quadrant_consensus(np.array([0, 1]), r, a)[0] is not None
    assert false / 4000 < 0.10


def test_association(spark):
    polygons = spark.createDataFrame([("p", xy([(0, 0), (1000, 0), (1000, 500), (0, 500)]))], f"k string, ring {RING}")
    edges = placement.edges_of(polygons, ["k"])
    assert [(round(r["length_px"]), round(r["angle_px"])) for r in edges.orderBy("edge_index").collect()] == [(1000, 90), (500, 180), (1000, 270), (500, 0)]
    lines = spark.createDataFrame([("p", 0, "N 89°00'00\" E 500.00'", 400.0, 20.0, 600.0, 40.0), ("p", 1, "250.0'", 960.0, 100.0, 980.0, 300.0), ("p", 2, "LOT 5", 1.0, 1.0, 2.0, 2.0), ("p", 3, "77", 500.0, 250.0, 520.0, 260.0)], "k string, line_no int, text string, x1 double, y1 double, x2 double, y2 double")
    c = placement.printed_candidates(lines, ["k"])
    assert {r["line_no"]: (r["value"], r["azimuth"]) for r in c.collect()} == {0: (500.0, 89.0), 1: (250.0, None), 3: (77.0, None)}
    assert {r["line_no"]: r["edge_index"] for r in placement.associate(c, edges, ["k"]).collect()} == {0: 0, 1: 1}


def solve_control(points, vertices, scale, rotations):
    """One sheet."""
    label = np.array([(p["label_px"]["x"], p["label_px"]["y"]) if p.get("label_px") else (np.nan, np.nan) for p in points]).reshape(-1, 2)
    en, px = np.array([(p["easting"], p["northing"]) for p in points], float).reshape(-1, 2), np.array([(v["x"], v["y"]) for v in vertices], float).reshape(-1, 2)
    one = lambda x: np.array([len(x)])
    out = placement.solve_controls((en, label, one(points)), (px, one(vertices)), np.array([np.nan if scale is None else scale], float), (np.array(rotations, float), one(rotations)))
    return tuple(c[0] for c in out)


def every_reading(points, vertices, scale, rotations):
    """Status, readings and the winner's fit by trying all pairs of points on all pairs of corners, one after another."""
    turn = lambda a, b: min(abs(a - b) % 360, 360 - abs(a - b) % 360)
    fits = []
    if len(points) >= 2 and scale and len(vertices) >= 3:
        for a, b in ((a, b) for a in range(len(points)) for b in range(len(points)) if a != b):
            de, dn = points[b]["easting"] - points[a]["easting"], points[b]["northing"] - points[a]["northing"]
            far, az = math.hypot(de, dn), math.degrees(math.atan2(de, dn)) % 360
            for i, j in ((i, j) for i in range(len(vertices)) for j in range(len(vertices)) if i != j):
                dx, dy = vertices[j]["x"] - vertices[i]["x"], vertices[j]["y"] - vertices[i]["y"]
                size, pix = math.hypot(dx, dy) * scale, math.degrees(math.atan2(dx, -dy)) % 360
                if not far or abs(size - far) > 0.025 * far:
                    continue
                rot = (az - pix) % 360
                if rotations:
                    near = min(rotations, key=lambda r: turn(r, rot))
                    if turn(near, rot) > 5:
                        continue
                    rot = near
                t = math.radians(pix + rot)
                off = math.hypot(points[a]["easting"] + size * math.sin(t) - points[b]["easting"], points[a]["northing"] + size * math.cos(t) - points[b]["northing"])
                if off <= max(3, 0.02 * far):
                    label = None if any(points[q]["label_px"] is None for q in (a, b)) else sum(math.dist((points[q]["label_px"]["x"], points[q]["label_px"]["y"]), (vertices[v]["x"], vertices[v]["y"])) for q, v in ((a, i), (b, j)))
                    key = (a, b, i, j) if a < b else (b, a, j, i)
                    fits.append((key, round(rot, 6), off, label))
    readings = {}
    for key, rot, off, label in fits:
        readings.setdefault((key, rot), []).append((off, label))
    best = [(min(v)[1], k) for k, v in readings.items()]
    if not best:
        return "unverified", 0, None
    best.sort(key=lambda x: (x[0] is None, x[0] or 0))
    if len(best) > 1 and (any(x[0] is None for x in best) or best[1][0] < 2 * max(best[0][0], 1)):
        return "ambiguous", len(best), None
    return "validated", len(best), best[0][1]


def test_control_points_of_many_sheets_at_once(spark, monkeypatch):
    """Random sheets against the loop, alone and in one batch, however few hypotheses are held at a time."""
    rng = random.Random(12)
    sheets = []
    for k in range(120):
        n = rng.choice([2, 3, 4, 5, 7])
        vertices = [{"x": float(300 * c + rng.randint(0, 60)), "y": float(170 * (c * c % 5) + rng.randint(0, 60))} for c in range(n)]
        if k % 3 == 0 and n >= 4:
            vertices[:4] = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (800.0, 0.0), (800.0, 500.0), (0.0, 500.0))]
        turn, scale = float(rng.randrange(0, 360, 15)), rng.choice([0.5, 0.25])
        t = math.radians(turn)
        points = []
        for v in rng.sample(vertices, min(n, rng.choice([1, 2, 2, 3]))):
            x, y = v["x"] * scale, -v["y"] * scale
            blur = rng.choice([0, 0, 0, 1.0, 40.0])
            points.append({"easting": 5000 + x * math.cos(t) + y * math.sin(t) + blur, "northing": 9000 - x * math.sin(t) + y * math.cos(t), "label_px": None if rng.random() < 0.3 else {"x": v["x"] + rng.uniform(-30, 30), "y": v["y"] + rng.uniform(-30, 30)}})
        sheets.append((k, points, vertices, rng.choice([scale, scale, scale, None, 0.0]), rng.choice([[turn], [turn, (turn + 180) % 360], [turn, (turn + 90) % 360], [(turn + 40) % 360]])))
    want = {k: every_reading(*rest) for k, *rest in sheets}
    assert {w[0] for w in want.values()} == {"validated", "ambiguous", "unverified"}

    def same(k, status, first, i, second, j, rotation, readings):
        assert (status, readings) == want[k][:2], (k, want[k])
        if status == "validated":
            key, rot = want[k][2]
            assert ((first, second, i, j) if first < second else (second, first, j, i)) == key and rotation == pytest.approx(rot, abs=1e-5)

    for k, *rest in sheets:
        g = solve_control(*rest)
        same(k, *g[:6], g[9])
    kind = "k int, points array<struct<easting:double,northing:double,label_px:struct<x:double,y:double>>>, vertices array<struct<x:double,y:double>>, scale_ft_per_px double, rotations array<double>"
    df = spark.createDataFrame([*sheets, (999, None, None, None, None), (998, [], [], 1.0, [])], kind).repartition(2)
    got = {r["k"]: r for r in placement.control_solutions(df, ["k"]).collect()}
    for k, *_ in sheets:
        r = got[k]
        same(k, r["status"], r["anchor_point"], r["anchor_vertex"], r["other_point"], r["other_vertex"], r["rotation_deg"], r["correspondences"])
    assert got[999]["status"] == got[998]["status"] == "unverified"


def test_control_points():
    px = [(0, 0), (1000, 0), (1000, 600), (0, 800)]
    scale, rot = 0.5, 30.0

    def ground(p):
        d, a = math.hypot(p[0], p[1]) * scale, math.radians(math.degrees(math.atan2(p[0], -p[1])) + rot)
        return {"easting": 5000 + d * math.sin(a), "northing": 9000 + d * math.cos(a)}

    vertices = xy(px)
    points = [{**ground(px[1]), "label_px": {"x": 1010.0, "y": 5.0}}, {**ground(px[3]), "label_px": {"x": -8.0, "y": 805.0}}]
    solved = solve_control(points, vertices, scale, [])
    assert solved[0] == "ambiguous" or (solved[2], solved[4]) in {(1, 3), (3, 1)}
    sure = solve_control(points, vertices, scale, [30.0])
    assert sure[0] == "validated" and {sure[2], sure[4]} == {1, 3} and sure[6] < 0.1
    assert solve_control(points, vertices, scale, [120.0])[0] == "unverified"
    assert solve_control(points[:1], vertices, scale, [])[0] == "unverified"
    both = solve_control(points, vertices, scale, [30.0, 210.0])
    assert both[0] == "validated" and {both[2], both[4]} == {1, 3}  # the labels decide
    blind = [{**p, "label_px": None} for p in points]
    assert solve_control(blind, vertices, scale, [30.0, 210.0])[0] == "ambiguous"


def test_aliquot_fit(spark):
    part = [(0.0, 0.005), (0.01, 0.005), (0.01, 0.0), (0.0, 0.0)]
    a, b = [(1.0, 1.0), (1.005, 1.0), (1.005, 1.005), (1.0, 1.005)], [(1.005, 1.0), (1.01, 1.0), (1.01, 1.005), (1.005, 1.005)]
    aliquots = spark.createDataFrame([("d", xy(part), 160.0, False), ("e", xy(part), 160.0, False)], f"document_id string, ring {RING}, acres double, portion_of boolean")
    parcels = spark.createDataFrame([("d", 1, "A", xy(a), 120.0, False), ("d", 1, "B", xy(b), 40.1, False), ("e", 1, "A", xy(a), 160.0, True)], f"document_id string, page_number int, id string, ring {RING}, acres double, pending boolean")
    got = {(r["document_id"], r["id"]): r for r in placement.aliquot_fit(parcels, aliquots).collect()}
    assert got["d", "A"]["corroborated"] and got["d", "A"]["fitted_ring"][0]["x"] == pytest.approx(0) and got["d", "B"]["fitted_ring"][1]["x"] == pytest.approx(0.01)
    assert got["e", "A"]["fits"] is None and got["e", "A"]["fitted_ring"] == got["e", "A"]["ring"]


# outlines and drawings


def test_outlines(spark):
    df = spark.createDataFrame([(xy([(0, 0), (100, 0), (100, 100), (0, 100)]), {0: [{"a": 0.5, "b": 0.2}]})], f"ring {RING}, curves map<int,array<struct<a:double,b:double>>>")
    p = df.select(outline.flatten_curves("ring", "curves").alias("p")).first()["p"]
    ys = [round(v["y"], 6) for v in p]
    assert len(p) > 12 and max(ys[:-2]) >= 20.0 and any(abs(v["x"] - 50) < 1e-9 and abs(v["y"] - 20) < 1e-9 for v in p)
    noisy = spark.createDataFrame([(xy([(0, 0), (50, 0.1), (100, 0), (100, 100), (101, 400), (100, 101), (0, 100)]),)], f"ring {RING}")
    s = noisy.select(outline.drop_spikes("ring", F.lit(25.0)).alias("s")).select(outline.simplify("s", F.lit(2.0)).alias("s")).first()["s"]
    assert len(s) == 4
    r = df.select(outline.longest_edge(F.col("ring")).alias("e"), outline.fit_in_box(F.col("ring"), 200.0, 400.0).alias("t"), outline.snap(F.lit(98.0), F.lit(3.0), F.col("ring"), F.lit(5.0)).alias("n"), outline.snap(F.lit(50.0), F.lit(50.0), F.col("ring"), F.lit(5.0)).alias("o")).first()
    assert r["e"]["edge"] == 0 and r["t"]["scale"] == pytest.approx(1.7) and tuple(r["n"]) == (100.0, 0.0) and tuple(r["o"]) == (50.0, 50.0)
    b = df.select(outline.bearing_between(F.lit(0.0), F.lit(0.0), F.lit(0.001), F.lit(0.001)).alias("b")).first()["b"]
    assert b["bearing"] in ("N 45°00'00\"E", "N 44°59'60\"E") and b["distance_ft"] == pytest.approx(516.5, abs=0.5)


def test_fill():
    grey = np.full((400, 600), 255, np.uint8)
    for box in ((50, 50, 250, 300), (250, 50, 500, 300)):
        x0, y0, x1, y1 = box
        grey[y0:y1, [x0, x0 + 1, x1, x1 + 1]] = 0
        grey[[y0, y0 + 1, y1, y1 + 1], x0:x1] = 0
    grey[150:154, 250:252] = 255  # a small break
    v, fraction, error = fill.fill_region(grey, 150, 170, gap=7)
    assert error is None and len(v) <= 8
    area = placement._area(v)
    assert area == pytest.approx(200 * 250, rel=0.05) and fraction == pytest.approx(area / grey.size, abs=0.02)
    leaky = grey.copy()
    leaky[150:200, 50:52] = 255
    assert fill.fill_region(leaky, 150, 170, gap=1)[2] == "leaked"
    assert fill.fill_region(grey, -5, 0)[2] == "outside"


def test_country_signals_and_grids(spark):
    df = spark.createDataFrame([("APN 1 NAD83 state plane", "SK3390SW"), ("Lot 2 DP 324915 LINZ", "SK3390"), ("nothing", "ZZ")], "t string, g string").coalesce(1)
    got = df.select(trials.country(F.col("t")).alias("c"), trials.os_grid(F.col("g")).alias("g")).collect()
    assert [r["c"] for r in got] == ["US", "NZ", None]
    assert tuple(got[0]["g"]) == (433_250.0, 390_250.0) and tuple(got[1]["g"]) == (433_500.0, 390_500.0) and got[2]["g"] is None
    best = spark.createDataFrame([(1, "Jaipur", "Jaipur City"), (1, "Jaipur", "Jaipr"), (2, "Agra", "Xyz")], "k int, name string, option string")
    assert {r["k"]: r["option"] for r in trials.best_name(best, ["k"]).collect()} == {1: "Jaipr"}
