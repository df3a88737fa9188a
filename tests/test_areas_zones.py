"""Areas of large rings against closed forms on the ellipsoid; all state-plane zones."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from plumbline.functions import geodesy as E
from plumbline.functions import zones as Z
from plumbline.operators import placement


def band(lat1, lat2, width):
    """Area between two parallels over a width in degrees."""
    q = lambda f: np.sin(f) / (1 - E.E2 * np.sin(f) ** 2) + np.arctanh(E.E * np.sin(f)) / E.E
    return E.A**2 * (1 - E.E2) / 2 * abs(q(np.radians(lat2)) - q(np.radians(lat1))) * np.radians(width)


def along(lat, west, east, n):
    return [(x, lat) for x in np.linspace(west, east, n)]


def area(points):
    return E.geodesic_area_m2(*np.array(points, float).T)


def test_triangles_of_meridians_and_equator():
    """Their edges are geodesics, so these are exact."""
    assert area([(0, 0), (90, 0), (0, 90)]) == pytest.approx(4 * np.pi * E.AUTHALIC2 / 8, rel=1e-13)
    for west, width in ((0, 10), (175, 10), (-200, 37.5), (100, 0.001)):
        for pole in (90, -90):
            got = area([(west, 0), (west + width, 0), (west + width, pole), (west, pole)])
            assert got == pytest.approx(E.AUTHALIC2 * np.radians(width), rel=1e-11, abs=0.1)
            assert area([(west, 0), (west + width / 2, 0), (west + width, 0), (-40, pole)]) == pytest.approx(got, rel=1e-11, abs=0.1)


def test_ten_degree_box_over_the_antimeridian():
    box = along(40, 175, 185, 40_001) + along(50, 185, 175, 40_001)
    assert area(box) == pytest.approx(band(40, 50, 10), rel=1e-9)
    wrapped = [((x + 180) % 360 - 180, y) for x, y in box]
    assert area(wrapped) == pytest.approx(area(box), rel=1e-12) == pytest.approx(area(box[::-1]), rel=1e-12)


@pytest.mark.parametrize("lat", [60, -75.5, 5, 80])
def test_ring_round_a_pole(lat):
    ring = along(lat, -180, 180, 200_001)[:-1]
    cap = band(lat, np.sign(lat) * 90, 360)
    assert area(ring) == pytest.approx(cap, rel=1e-9) == pytest.approx(area(ring[::-1]), rel=1e-9)


def test_small_rings_are_flat():
    for lon, lat in ((3, 45), (179.9999, -12), (-71, 0), (20, 89)):
        z = E.Zone(0, "", "", "tm", lat, lon, 1.0, 0.0, 0.0, unit=1.0)
        x = np.array([0, 900, 700, -100.0])
        y = np.array([0, 50, 600, 400.0])
        points = np.column_stack(E.inverse(z, x, y))
        flat = abs(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y)) / 2
        assert area(points) == pytest.approx(flat, rel=1e-6)


def test_pieces_add_up():
    """A long quadrilateral is the sum of its two triangles, at any place."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        lon = rng.uniform(-180, 180) + np.array([0, 60, 70, 5]) + rng.uniform(-5, 5, 4)
        lat = np.array([-20, -10, 40, 50]) + rng.uniform(-9, 9, 4)
        whole = E.geodesic_area_m2(lon, lat)
        parts = E.geodesic_areas_m2(np.r_[lon[[0, 1, 2]], lon[[0, 2, 3]]], np.r_[lat[[0, 1, 2]], lat[[0, 2, 3]]], np.array([3, 3]))
        assert parts.sum() == pytest.approx(whole, rel=1e-11)


def test_rows_without_a_ring(spark):
    rows = [(1, None), (2, []), (3, [(0.0, 0.0), (1.0, 1.0)]), (4, [(0.0, 0.0), (90.0, 0.0), (0.0, 90.0)])]
    got = spark.createDataFrame(rows, "k int, r array<struct<x:double,y:double>>").coalesce(1).select("k", E.area_km2("r").alias("a")).collect()
    assert [r["a"] for r in got[:3]] == [None] * 3 and got[3]["a"] == pytest.approx(np.pi * E.AUTHALIC2 / 2e6)


STATES = """Alabama,Alaska,Arizona,Arkansas,California,Colorado,Connecticut,Delaware,Florida,Georgia,Hawaii,Idaho,Illinois,Indiana,Iowa,Kansas,Kentucky,Louisiana,Maine,Maryland,
Massachusetts,Michigan,Minnesota,Mississippi,Missouri,Montana,Nebraska,Nevada,New Hampshire,New Jersey,New Mexico,New York,North Carolina,North Dakota,Ohio,Oklahoma,Oregon,Pennsylvania,
Rhode Island,South Carolina,South Dakota,Tennessee,Texas,Utah,Vermont,Virginia,Washington,West Virginia,Wisconsin,Wyoming""".replace("\n", "").split(",")


def test_every_state_has_its_zones():
    assert {z.state for z in E.ZONES} - {"Puerto Rico & Virgin Is."} == set(STATES) and len(STATES) == 50
    assert len({z.epsg for z in E.ZONES}) == len(E.ZONES) > 110 and len(E.BY_EPSG) == len(E.ZONES)
    counts = {s: sum(z.state == s for z in E.ZONES) for s in ("California", "Texas", "Alaska", "Nevada", "Montana", "New York")}
    assert counts == {"California": 6, "Texas": 5, "Alaska": 10, "Nevada": 3, "Montana": 1, "New York": 4}


@pytest.mark.parametrize("zone", E.ZONES, ids=lambda z: z.name)
def test_zone(zone):
    """Round trip under a millimetre over the area of use, the false origin, and the scale where the definition gives it."""
    west, south, east, north = zone.bounds
    lon, lat = (v.ravel() for v in np.meshgrid(np.linspace(west, east, 9), np.linspace(south, north, 9)))
    x, y = E.forward(zone, lon, lat)
    back = E.inverse(zone, x, y)
    assert np.abs(back[0] - lon).max() * 111320 < 1e-3 and np.abs(back[1] - lat).max() * 111320 < 1e-3
    assert 0 < west - -185 and south < north and west < east

    def scale(lon, lat):
        """Of the plane along a parallel, by small differences."""
        d = 1e-5
        (x0, x1), (y0, y1) = E.forward(zone, np.array([lon - d, lon + d]), np.full(2, lat))
        radius = E.A / np.sqrt(1 - E.E2 * np.sin(np.radians(lat)) ** 2)
        return np.hypot(x1 - x0, y1 - y0) * zone.unit / (radius * np.cos(np.radians(lat)) * np.radians(2 * d))

    middle = (south + north) / 2
    if zone.kind == "om":
        assert scale(zone.lon0, zone.lat0) == pytest.approx(zone.k0, abs=1e-7)
        return
    origin = E.forward(zone, np.array([zone.lon0]), np.array([zone.lat0]))
    assert origin[0][0] * zone.unit == pytest.approx(zone.false_east, abs=1e-6) and origin[1][0] * zone.unit == pytest.approx(zone.false_north, abs=1e-6)
    if zone.kind == "tm":
        assert scale(zone.lon0, middle) == pytest.approx(zone.k0, abs=1e-8)
    else:
        assert scale(zone.lon0, zone.lat1) == pytest.approx(1, abs=1e-8) == pytest.approx(scale(zone.lon0 + 1, zone.lat2), abs=1e-8)
        assert zone.lat0 < zone.lat2 < zone.lat1 < north + 1 and south - 1 < zone.lat2
    # definitions and areas belong together: the area's middle is near the origin's meridian, and scale is close to 1 there
    assert abs((west + east) / 2 - zone.lon0) < 4 and abs(scale((west + east) / 2, middle) - 1) < 7e-4


def test_oblique_zone_centre():
    """The published grid position of the centre of the zone."""
    z = E.BY_EPSG[26931]
    x, y = E.forward(z, np.array([z.lon0]), np.array([z.lat0]))
    assert (x[0], y[0]) == (pytest.approx(818676.7344, abs=0.01), pytest.approx(575097.6889, abs=0.01))


def test_smallest_area_that_holds_a_point(spark):
    points = [("reno", -119.8, 39.5, "Nevada"), ("border", -119.8, 39.5, None), ("nyc", -73.9, 40.7, "New York"), ("nyc2", -73.9, 40.7, None), ("sea", -40.0, 40.0, None), ("wrong", -119.8, 39.5, "Texas"), ("juneau", -134.4, 58.3, "alaska"), ("houston", -95.4, 29.8, "Texas"), (None, None, None, None)]
    df = spark.createDataFrame(points, "k string, lon double, lat double, state string")
    index = Z.zone_index(spark, E.zones_frame(spark))
    got = {r["k"]: r["zone_name"] for r in Z.with_zone(df, index, F.col("state")).collect()}
    want = {}
    for k, lon, lat, state in points:
        inside = [z for z in E.ZONES if lon is not None and z.bounds[0] <= lon <= z.bounds[2] and z.bounds[1] <= lat <= z.bounds[3] and (state or "").lower() in z.name.lower()]
        want[k] = min(inside, key=lambda z: ((z.bounds[2] - z.bounds[0]) * (z.bounds[3] - z.bounds[1]), z.epsg)).name if inside else None
    assert got == want and got["reno"] == "NAD83 / Nevada West (ftUS)" and got["nyc"] == "NAD83 / New York Long Island (ftUS)" and got["border"] == "NAD83 / California zone 2 (ftUS)" and got["sea"] is None is got["wrong"]


def test_conversions_of_a_printed_pair(spark):
    z = E.BY_EPSG[3423]
    x, y = E.forward(z, np.array([-119.77]), np.array([39.59]))
    rows = [("a", "Nevada", float(y[0]) / 1.0002, float(x[0]) / 1.0002, 1.0002, -119.777, 39.59), ("b", "Utah", 7e6, 1.5e6, None, None, None), ("c", "Atlantis", 1.0, 1.0, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, state string, northing double, easting double, ground_to_grid double, alon double, alat double")
    got = placement.convert_state_plane(df, E.zones_frame(spark), ["k"]).orderBy("k", "place").collect()
    assert [(r["k"], r["place"]) for r in got] == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("b", 2)]
    assert (got[0]["epsg"], got[0]["lon"], got[0]["lat"]) == (3423, -119.77, 39.59) and got[0]["from_anchor_m"] == pytest.approx(600, abs=5)
    assert {r["zone_name"].split()[2] for r in got[3:]} == {"Utah"} and got[3]["from_anchor_m"] is None
