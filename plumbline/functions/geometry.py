"""Angles, lines, boxes, rings and map projections of screens, as Column expressions.

A ring or walk is ARRAY<STRUCT<x, y>>; pixel frames have y down, local frames are feet east and north.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XY = "array<struct<x:double,y:double>>"
M_PER_DEG_LON, M_PER_DEG_LAT = 111_320.0, 110_540.0


def circular_diff(a: Column, b: Column, period: float) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(float(period)))
    return F.least(d, period - d)


def signed_diff(a: Column, b: Column) -> Column:
    return F.pmod(a - b + 180, F.lit(360.0)) - 180


def metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    lat = F.radians((lat1 + lat2) / 2)
    return F.hypot((lon1 - lon2) * M_PER_DEG_LON * F.cos(lat), (lat1 - lat2) * M_PER_DEG_LAT)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371.0) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(h))


def direction(dx: Column, dy: Column) -> Column:
    """Azimuth of a step east ``dx``, north ``dy``."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / n)))
    return F.hypot(px - ax - t * dx, py - ay - t * dy)


def curve_chord(tangent_in: Column, delta: Column, radius: Column, turn: Column) -> Column:
    """(azimuth, distance, tangent_out) of a circular curve's chord; turns right unless told otherwise."""
    s = F.when(F.upper(F.coalesce(turn, F.lit("R"))) == "L", -1.0).otherwise(1.0)
    return F.struct(
        F.pmod(tangent_in + s * delta / 2, F.lit(360.0)).alias("azimuth"),
        (2 * radius * F.sin(F.radians(delta / 2))).alias("distance"),
        F.pmod(tangent_in + s * delta, F.lit(360.0)).alias("tangent_out"),
    )


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes (x, y, w, h)."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def padded_box(box: Column, page_w: Column, page_h: Column, kind: Column) -> Column:
    """Crop box: drawings get max(40, 8 %) on each side, clipped to the page."""

    def margin(side: Column) -> Column:
        return F.when(kind == "ParcelMap", F.greatest(F.lit(40.0), side * 0.08)).otherwise(0.0)

    mx, my = margin(box["w"]), margin(box["h"])
    x1, y1 = F.greatest(F.lit(0.0), box["x"] - mx), F.greatest(F.lit(0.0), box["y"] - my)
    x2, y2 = F.least(page_w, box["x"] + box["w"] + mx), F.least(page_h, box["y"] + box["h"] + my)
    return F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h"))


def yolo_box(box: Column, w: Column, h: Column) -> Column:
    return F.array((box["x"] + box["w"] / 2) / w, (box["y"] + box["h"] / 2) / h, box["w"] / w, box["h"] / h)


def pixel_place(px, py, ax, ay, east, north, rotation, scale) -> Column:
    """(east, north) of a pixel, from an anchor pixel of known position."""
    dx, dy = (px - ax) * scale, -(py - ay) * scale
    az, d = F.radians(F.pmod(F.degrees(F.atan2(dx, dy)) + rotation, F.lit(360.0))), F.hypot(dx, dy)
    return F.struct((east + d * F.sin(az)).alias("x"), (north + d * F.cos(az)).alias("y"))


# rings

def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, v: s + v)


def _rotated(ring: Column) -> Column:
    """Each vertex's successor, the last one's being the first."""
    return F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))


def signed_area(ring: Column) -> Column:
    """Shoelace sum with wrap; counter-clockwise is positive. A closing copy of the first vertex changes nothing."""
    return _sum(F.zip_with(ring, _rotated(ring), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2


def ring_area(ring: Column) -> Column:
    return F.when(F.size(ring) >= 3, F.abs(signed_area(ring))).otherwise(0.0)


def open_area(points: Column) -> Column:
    """Area of a walk without its last point; under three corners 0."""
    return ring_area(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))))


def path_length(points: Column) -> Column:
    """Length along consecutive points, not closed."""
    return F.when(F.size(points) < 2, 0.0).otherwise(_sum(F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points)), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))))


def vertex_mean(ring: Column) -> Column:
    """Mean of the vertices, a closing copy left out."""
    closed = (F.size(ring) > 1) & (F.get(ring, 0) == F.element_at(ring, -1))
    own = F.when(closed, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)

    def mean(axis: str) -> Column:
        return (_sum(F.transform(own, lambda p: p[axis])) / F.size(own)).alias(axis)

    return F.struct(mean("x"), mean("y"))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd ray cast."""
    def cross(a: Column, b: Column) -> Column:
        return F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1.0).otherwise(0.0)

    return _sum(F.zip_with(ring, _rotated(ring), cross)) % 2 == 1


def on_edge(ring: Column, x: Column, y: Column, eps: float = 1e-12) -> Column:
    near = F.zip_with(ring, _rotated(ring), lambda a, b: point_segment_distance(x, y, a["x"], a["y"], b["x"], b["y"]) <= eps)
    return F.exists(near, lambda v: v)


def covers(ring: Column, x: Column, y: Column) -> Column:
    """Inside or on the outline."""
    return contains(ring, x, y) | on_edge(ring, x, y)


def close_ring(points: Column) -> Column:
    return F.when(F.get(points, 0) == F.element_at(points, -1), points).otherwise(F.concat(points, F.slice(points, 1, 1)))


def round_ring(points: Column, digits: int) -> Column:
    return F.transform(points, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))


def translate_ring(ring: Column, dx: Column, dy: Column) -> Column:
    return F.transform(ring, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def rotate_lonlat_ring(ring: Column, lon0: Column, lat0: Column, clockwise: Column) -> Column:
    """Clockwise turn about a pivot, in local metres."""
    kx, a = M_PER_DEG_LON * F.cos(F.radians(lat0)), F.radians(clockwise)

    def turn(p: Column) -> Column:
        e, n = (p["x"] - lon0) * kx, (p["y"] - lat0) * M_PER_DEG_LAT
        return F.struct((lon0 + (e * F.cos(a) + n * F.sin(a)) / kx).alias("x"), (lat0 + (n * F.cos(a) - e * F.sin(a)) / M_PER_DEG_LAT).alias("y"))

    return F.transform(ring, turn)


def px_ring_to_local(ring: Column, scale: Column, rotation: Column, pivot: Column, local_pivot: Column) -> Column:
    return F.transform(ring, lambda p: pixel_place(p["x"], p["y"], pivot["x"], pivot["y"], local_pivot["x"], local_pivot["y"], rotation, scale))


def lonlat_area_acres(ring: Column) -> Column:
    """Flat area of a lon/lat ring at its mean latitude, in acres."""
    lat = vertex_mean(ring)["y"]
    flat = F.transform(ring, lambda p: F.struct((p["x"] * M_PER_DEG_LON * F.cos(F.radians(lat))).alias("x"), (p["y"] * M_PER_DEG_LAT).alias("y")))
    return F.round(ring_area(flat) * 10.7639 / 43_560, 3)


# screens

def mercator_px(lon: Column, lat: Column, zoom: Column) -> Column:
    """Web-Mercator pixel, latitude clamped to 85.05."""
    n = 256 * F.pow(F.lit(2.0), zoom)
    s = F.radians(F.greatest(F.lit(-85.05), F.least(F.lit(85.05), lat)))
    return F.struct(((lon + 180) / 360 * n).alias("x"), ((1 - F.log(F.tan(s) + 1 / F.cos(s)) / F.lit(3.141592653589793)) / 2 * n).alias("y"))


def zoom_for(lon1, lat1, lon2, lat2, width: float, height: float, fill: float, most: int) -> Column:
    """Largest zoom at which a box fits the given fraction of a picture; 2 at least."""
    def fits(z: Column) -> Column:
        a, b = mercator_px(lon1, lat1, z), mercator_px(lon2, lat2, z)
        return (F.abs(b["x"] - a["x"]) <= width * fill) & (F.abs(b["y"] - a["y"]) <= height * fill)

    return F.coalesce(F.get(F.filter(F.sequence(F.lit(most), F.lit(2), F.lit(-1)), fits), 0), F.lit(2))


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.floor((lon + 180) / 6).cast("int") + 1
    return F.when(lat >= 0, 32_600 + zone).otherwise(32_700 + zone)


def image_tokens(w: Column, h: Column) -> Column:
    return F.ceil(w / 768) * F.ceil(h / 768) * 258


def text_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def bilinear(ll: Column, lr: Column, ul: Column, ur: Column, u: Column, v: Column) -> Column:
    """Point at fractions u (east) and v (north) of a quadrilateral."""
    mix = lambda a: (ll[a] * (1 - u) * (1 - v) + lr[a] * u * (1 - v) + ul[a] * (1 - u) * v + ur[a] * u * v).alias(a)
    return F.struct(mix("x"), mix("y"))


def aliquot_box(parts: Column) -> Column:
    """Unit box (x1, y1, x2, y2) of an aliquot chain such as ['N', 'SE'], innermost part first."""
    start = F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(1.0).alias("x2"), F.lit(1.0).alias("y2"))

    def cut(b: Column, p: Column) -> Column:
        mx, my = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
        return F.struct(
            F.when(p.contains("E"), mx).otherwise(b["x1"]).alias("x1"),
            F.when(p.contains("N"), my).otherwise(b["y1"]).alias("y1"),
            F.when(p.contains("W"), mx).otherwise(b["x2"]).alias("x2"),
            F.when(p.contains("S"), my).otherwise(b["y2"]).alias("y2"),
        )

    return F.aggregate(F.reverse(parts), start, cut)
