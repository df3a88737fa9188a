"""Drawn outlines: curved edges, simplification, spikes, snapping and screen transforms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import geometry as G
from ..functions.geodesy import RING

Points = np.ndarray


def _ring(values) -> Points:
    return np.array([(p["x"], p["y"]) for p in values], float).reshape(-1, 2)


def _rows(points: Points) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in points]


def from_chord(p0: Column, p1: Column, a: Column, b: Column) -> Column:
    dx, dy = p1["x"] - p0["x"], p1["y"] - p0["y"]
    return F.struct((p0["x"] + a * dx - b * dy).alias("x"), (p0["y"] + a * dy + b * dx).alias("y"))


def to_chord(p0: Column, p1: Column, c: Column) -> Column:
    dx, dy, rx, ry = p1["x"] - p0["x"], p1["y"] - p0["y"], c["x"] - p0["x"], c["y"] - p0["y"]
    n = F.when(dx * dx + dy * dy == 0, 1.0).otherwise(dx * dx + dy * dy)
    return F.struct(((rx * dx + ry * dy) / n).alias("a"), ((-rx * dy + ry * dx) / n).alias("b"))


def spline(anchors: Points) -> Points:
    """Catmull-Rom through anchors: 6 to 40 samples a span, about one per 12 px."""
    out = [anchors[:1]]
    for i in range(len(anchors) - 1):
        before, after = anchors[max(i - 1, 0)], anchors[min(i + 2, len(anchors) - 1)]
        p0, p3 = anchors[i], anchors[i + 1]
        p1, p2 = p0 + (p3 - before) / 6, p3 - (after - p0) / 6
        hull = np.hypot(*(p1 - p0)) + np.hypot(*(p2 - p1)) + np.hypot(*(p3 - p2))
        t = (np.arange(n := max(6, min(40, math.floor(hull / 12 + 0.5)))) + 1)[:, None] / n
        u = 1 - t
        out.append(u**3 * p0 + 3 * u * u * t * p1 + 3 * u * t * t * p2 + t**3 * p3)
    return np.concatenate(out)


@F.pandas_udf(RING)
def flatten_curves(ring: pd.Series, curves: pd.Series) -> pd.Series:
    """Corners and samples of curved edges; ``curves`` maps an edge to its waypoints (a, b) in the edge's own frame."""

    def one(r, c):
        if r is None:
            return None
        p, out, bends = _ring(r), [], dict(c or {})
        for i in range(len(p)):
            out.append(_edge(p[i], p[(i + 1) % len(p)], bends.get(i))[:-1])
        return _rows(np.concatenate(out))

    return pd.Series([one(*v) for v in zip(ring, curves)])


def _edge(p0: Points, p1: Points, ways) -> Points:
    """The drawn edge from p0 to p1 as a path."""
    d = p1 - p0
    mid = [p0 + w["a"] * d + w["b"] * np.array([-d[1], d[0]]) for w in (ways if ways is not None else [])]
    return spline(np.array([p0, *mid, p1])) if mid else np.array([p0, p1])


def _per_edge(f):
    """A pandas UDF of ring, curves, edge number and a point that answers with a point."""

    def run(ring: pd.Series, curves: pd.Series, edge: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for r, c, i, a, b in zip(ring, curves, edge, x, y):
            p, i = _ring(r), int(i)
            rows.append(f(_edge(p[i], p[(i + 1) % len(p)], dict(c or {}).get(i)), np.array([a, b], float)))
        return pd.DataFrame(rows, columns=["x", "y"])

    run.__doc__ = f.__doc__
    return F.pandas_udf(run, StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))


def _halfway(path: Points, _) -> Points:
    """Halfway along a drawn edge (the point is not used)."""
    at = np.r_[0, np.cumsum(np.hypot(*np.diff(path, axis=0).T))]
    return np.array([np.interp(at[-1] / 2, at, path[:, k]) for k in (0, 1)])


def _closest(path: Points, point: Points) -> Points:
    """The point of a drawn edge that is nearest to a given one."""
    a, d = path[:-1], np.diff(path, axis=0)
    n = (d**2).sum(1)
    t = np.clip(((point - a) * d).sum(1) / np.where(n > 0, n, 1), 0, 1)
    q = a + t[:, None] * d
    return q[((q - point) ** 2).sum(1).argmin()]


edge_midpoint = _per_edge(_halfway)
nearest_on_edge = _per_edge(_closest)

_WAY = "struct<a:double,b:double>"
STRAIGHT = 0.003  # a lone waypoint nearer than this to its chord, in chord lengths, bends nothing


def _tidy(ways: Column) -> Column:
    """Waypoints of an edge, or null for a straight one."""
    flat = (F.size(ways) == 1) & (F.abs(F.get(ways, 0)["b"]) < STRAIGHT)
    return F.when((F.size(ways) > 0) & ~flat, ways)


def _renumbered(curves: Column, to) -> Column:
    """Curves with edge numbers mapped by ``to``; edges that go to null are dropped."""
    entries = F.transform(F.map_entries(curves), lambda e: F.struct(to(e["key"]).cast("int").alias("key"), e["value"].alias("value")))
    return F.filter(entries, lambda e: e["key"].isNotNull() & e["value"].isNotNull())


def curves_after_insert(ring: Column, curves: Column, edge: Column, vertex: Column) -> Column:
    """Curves when ``vertex``, a point on edge ``edge``, becomes a corner: its waypoints go to the half they lie on, in the new halves' frames."""
    p0, p1 = F.get(ring, edge), F.get(ring, F.pmod(edge + 1, F.size(ring)).cast("int"))
    split = to_chord(p0, p1, vertex)["a"]
    ways = F.coalesce(F.try_element_at(curves, edge), F.array().cast(f"array<{_WAY}>"))
    half = lambda keep, a, b: _tidy(F.transform(F.filter(ways, keep), lambda w: to_chord(a, b, from_chord(p0, p1, w["a"], w["b"]))))
    both = F.array(F.struct(edge.cast("int").alias("key"), half(lambda w: w["a"] < split, p0, vertex).alias("value")), F.struct((edge + 1).cast("int").alias("key"), half(lambda w: w["a"] >= split, vertex, p1).alias("value")))
    others = _renumbered(curves, lambda k: F.when(k < edge, k).when(k > edge, k + 1))
    return F.map_from_entries(F.concat(others, F.filter(both, lambda e: e["value"].isNotNull())))


def curves_after_delete(curves: Column, vertex: Column, corners: Column) -> Column:
    """Curves when a corner goes: the two edges that met there become a straight one."""
    before = F.pmod(vertex - 1, corners)
    return F.map_from_entries(_renumbered(curves, lambda k: F.when((k != vertex) & (k != before), F.when(k > vertex, k - 1).otherwise(k))))


def migrated_curves(text: Column) -> Column:
    """Saved curves (JSON) as waypoints: an edge that has one quadratic control point [a, b] gets the apex of that curve instead."""
    raw = F.map_entries(F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>")))
    point = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    read = F.transform(raw, lambda e: F.struct(e["key"].cast("int").alias("key"), F.from_json(e["value"], "array<double>").alias("one"), F.from_json(e["value"], "array<array<double>>").alias("ways")))
    control = lambda e: F.coalesce((F.size(e["one"]) == 2) & F.forall(e["one"], lambda v: v.isNotNull()), F.lit(False))
    whole = lambda e: F.coalesce((F.size(e["ways"]) > 0) & F.forall(e["ways"], lambda w: F.coalesce(F.size(w) == 2, F.lit(False))), F.lit(False))
    apex = lambda e: F.array(point(0.5 * F.get(e["one"], 0) + 0.25, 0.5 * F.get(e["one"], 1)))
    kept = F.transform(F.filter(read, lambda e: control(e) | whole(e)), lambda e: F.struct(e["key"].alias("key"), F.when(control(e), apex(e)).otherwise(F.transform(e["ways"], lambda w: point(F.get(w, 0), F.get(w, 1)))).alias("value")))
    return F.map_from_entries(kept)


def _drop_while(p: Points, bad) -> Points:
    """Drops the first vertex that ``bad`` names, again and again, three left at least."""
    while len(p) > 3:
        k = next((i for i in range(len(p)) if bad(p[i - 1], p[i], p[(i + 1) % len(p)])), None)
        if k is None:
            break
        p = np.delete(p, k, axis=0)
    return p


def without_spikes(p: Points, least: float) -> Points:
    def sharp(a, b, c):
        u, v = a - b, c - b
        n = np.hypot(*u) * np.hypot(*v)
        return n == 0 or math.degrees(math.acos(max(-1.0, min(1.0, float(u @ v) / n)))) < least

    return _drop_while(p, sharp)


@F.pandas_udf(RING)
def drop_spikes(ring: pd.Series, least_angle: pd.Series) -> pd.Series:
    """Without vertices whose inner angle is too sharp, or that repeat a neighbour."""
    return pd.Series([None if r is None else _rows(without_spikes(_ring(r), least)) for r, least in zip(ring, least_angle)])


@F.pandas_udf(RING)
def simplify(ring: pd.Series, tolerance: pd.Series) -> pd.Series:
    """Without vertices that lie within ``tolerance`` of the line between their neighbours."""

    def one(r, tol):
        def flat(a, b, c):
            d = c - a
            n = np.hypot(*d)
            return abs(d[0] * (b - a)[1] - d[1] * (b - a)[0]) / n <= tol if n else True

        return None if r is None else _rows(_drop_while(_ring(r), flat))

    return pd.Series([one(*v) for v in zip(ring, tolerance)])


def fit_in_box(ring: Column, width: float, height: float, pad: float = 0.85) -> Column:
    """(scale, cx, cy): the display transform that fits a local ring into a picture."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    span = lambda v: F.array_max(v) - F.array_min(v)
    mid = lambda v: (F.array_max(v) + F.array_min(v)) / 2
    scale = F.least(F.try_divide(F.lit(width * pad), span(xs)), F.try_divide(F.lit(height * pad), span(ys)))
    return F.struct(scale.alias("scale"), mid(xs).alias("cx"), mid(ys).alias("cy"))


def box_to_local(px: Column, t: Column, width: float, height: float) -> Column:
    """The inverse for a ring of pixels (y down)."""
    return F.transform(px, lambda p: F.struct((t["cx"] + (p["x"] - width / 2) / t["scale"]).alias("x"), (t["cy"] - (p["y"] - height / 2) / t["scale"]).alias("y")))


def snap(x: Column, y: Column, targets: Column, radius: Column) -> Column:
    """The nearest target strictly within a radius, else the point itself."""
    ranked = F.array_sort(F.transform(targets, lambda t, i: F.struct(F.hypot(t["x"] - x, t["y"] - y).alias("d"), i.alias("i"), t["x"].alias("x"), t["y"].alias("y"))))
    best = F.get(ranked, 0)
    own = F.struct(x.alias("x"), y.alias("y"))
    return F.when(best["d"] < radius, F.struct(best["x"].alias("x"), best["y"].alias("y"))).otherwise(own)


def longest_edge(ring: Column) -> Column:
    """(index, midpoint) of the longest edge, the first on a tie."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    e = F.transform(F.arrays_zip(ring.alias("a"), nxt.alias("b")), lambda z, i: F.struct(F.hypot(z["b"]["x"] - z["a"]["x"], z["b"]["y"] - z["a"]["y"]).alias("d"), (-i).alias("k"), ((z["a"]["x"] + z["b"]["x"]) / 2).alias("x"), ((z["a"]["y"] + z["b"]["y"]) / 2).alias("y")))
    top = F.array_max(e)
    return F.struct((-top["k"]).alias("edge"), top["x"].alias("x"), top["y"].alias("y"))


def bearing_between(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """(bearing, distance_ft) between two positions on a sphere of 20,925,646.3 ft; seconds may round to 60."""
    dl = F.radians(lon2 - lon1)
    p1, p2 = F.radians(lat1), F.radians(lat2)
    az = F.pmod(F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))), F.lit(360.0))
    q = F.when(az <= 90, az).when(az <= 180, 180 - az).when(az <= 270, az - 180).otherwise(360 - az)
    ns, ew = F.when((az <= 90) | (az > 270), "N").otherwise("S"), F.when(az <= 180, "E").otherwise("W")
    d = F.floor(q)
    m = F.floor((q - d) * 60)
    s = F.round(((q - d) * 60 - m) * 60).cast("int")
    return F.struct(F.format_string("%s %d°%02d'%02d\"%s", ns, d, m, s, ew).alias("bearing"), F.round(G.haversine(lon1, lat1, lon2, lat2, 20_925_646.3), 2).alias("distance_ft"))


def wire_calls(calls: Column) -> Column:
    """Edited rows without the empty ones: a curve needs radius and delta, a line a bearing or a distance."""
    full = lambda v: F.coalesce(F.trim(v), F.lit("")) != ""
    return F.filter(calls, lambda c: F.when(c["call_type"] == "curve", full(c["radius"]) & full(c["delta"])).otherwise(full(c["bearing"]) | full(c["distance"])))
