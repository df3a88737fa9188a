"""Coordinate geometry: calls to walks, and what a walk says about itself.

``calls`` has one row a call: the parcel's key columns, seq, call_type ('line' or 'curve'), bearing, distance, delta, radius,
arc_length, turn, start_tangent_bearing.  Lines alone are walked by one window; with curves the tangent is state, so a
parcel's calls are folded in order by a higher-order ``aggregate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T

MIN_PRECISION, AREA_TOLERANCE, CLOSED_RATIO = 2000, 0.15, 0.01
CALL_FIELDS = ("call_type", "bearing", "distance", "delta", "radius", "arc_length", "turn", "start_tangent_bearing")


def merge_curve_calls(lines: DataFrame, curves: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (keys, seq from 0) and curves (keys, pos, after_call_index) in walking order.

    A curve follows the line it names (-1: before the first).  Curves without an index, or past the last line, go.
    """
    n = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    kept = curves.join(n, keys, "left").filter((F.col("after_call_index") >= -1) & (F.col("after_call_index") < F.coalesce("_n", F.lit(0))))
    a = lines.select(*keys, F.lit("line").alias("call_type"), "bearing", "distance", F.col("seq").alias("_at"), F.lit(0).alias("_kind"), F.col("seq").alias("_pos"))
    b = kept.select(*keys, F.lit("curve").alias("call_type"), *(c for c in CALL_FIELDS[3:] if c in curves.columns), F.col("after_call_index").alias("_at"), F.lit(1).alias("_kind"), F.col("pos").alias("_pos"))
    order = Window.partitionBy(*keys).orderBy("_at", "_kind", "_pos")
    return a.unionByName(b, allowMissingColumns=True).withColumn("seq", F.row_number().over(order) - 1).drop("_at", "_kind", "_pos")


_POINT = "struct<x:double,y:double>"
_CURVE = "struct<call_index:int,radius_ft:double,delta_deg:double,turn:string,tangent_in_azimuth:double,tangent_out_azimuth:double,used_explicit_start_tangent:boolean,chord_azimuth:double,chord_distance_ft:double,computed_arc_length_ft:double,stated_arc_length_ft:double,signed_segment_area_sqft:double,arc_length_mismatch_ft:double>"


def read_call(has: set[str]) -> Column:
    """Numbers of one call's texts, read once per call: the fold below only does arithmetic."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in has else F.lit("")
    number = lambda f, c: f(text(c)) if c in has else F.lit(None).cast("double")
    return F.struct(
        (F.col("call_type") == "curve" if "call_type" in has else F.lit(False)).alias("curve"),
        ((F.lower(F.trim(text("bearing"))) == "null") | (F.lower(F.trim(text("distance"))) == "null")).alias("blank"),
        number(T.azimuth, "bearing").alias("azimuth"), number(T.distance, "distance").alias("distance"),
        number(T.delta, "delta").alias("delta"), number(T.distance, "radius").alias("radius"), number(T.distance, "arc_length").alias("arc"),
        (F.upper(F.coalesce(F.col("turn").cast("string"), F.lit("R"))) if "turn" in has else F.lit("R")).alias("turn"),
        number(T.azimuth, "start_tangent_bearing").alias("told"),
    )


def walk_array(numbers: Column) -> Column:
    """Struct (points, unparsed_calls, closure_error_ft, curves) of an ordered array of ``read_call`` structs."""
    start = F.struct(
        F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))).cast(f"array<{_POINT}>").alias("points"),
        F.lit(None).cast("double").alias("tangent"),
        F.lit(0).alias("unparsed"),
        F.lit(0).alias("i"),
        F.array().cast(f"array<{_CURVE}>").alias("curves"),
    )

    def line(s: Column, c: Column) -> Column:
        good = c["azimuth"].isNotNull() & c["distance"].isNotNull() & ~c["blank"]
        last = F.element_at(s["points"], -1)
        point = F.struct((last["x"] + c["distance"] * F.sin(F.radians(c["azimuth"]))).alias("x"), (last["y"] + c["distance"] * F.cos(F.radians(c["azimuth"]))).alias("y"))
        return F.struct(
            F.when(good, F.concat(s["points"], F.array(point))).otherwise(s["points"]).alias("points"),
            F.when(good, c["azimuth"]).otherwise(s["tangent"]).alias("tangent"),
            (s["unparsed"] + F.when(good | c["blank"], 0).otherwise(1)).alias("unparsed"),
            (s["i"] + 1).alias("i"),
            s["curves"].alias("curves"),
        )

    def bend(s: Column, c: Column) -> Column:
        tangent = F.coalesce(c["told"], s["tangent"])
        good = F.coalesce(c["delta"].isNotNull() & (c["radius"] > 0) & tangent.isNotNull(), F.lit(False))
        chord = G.curve_chord(tangent, c["delta"], c["radius"], c["turn"])
        last = F.element_at(s["points"], -1)
        point = F.struct((last["x"] + chord["distance"] * F.sin(F.radians(chord["azimuth"]))).alias("x"), (last["y"] + chord["distance"] * F.cos(F.radians(chord["azimuth"]))).alias("y"))
        angle = F.radians(c["delta"])
        segment, arc = 0.5 * c["radius"] * c["radius"] * (angle - F.sin(angle)), c["radius"] * angle
        note = F.struct(
            s["i"].alias("call_index"), c["radius"].alias("radius_ft"), c["delta"].alias("delta_deg"), c["turn"].alias("turn"),
            F.round(tangent, 4).alias("tangent_in_azimuth"), F.round(chord["tangent_out"], 4).alias("tangent_out_azimuth"), c["told"].isNotNull().alias("used_explicit_start_tangent"),
            F.round(chord["azimuth"], 4).alias("chord_azimuth"), F.round(chord["distance"], 2).alias("chord_distance_ft"),
            F.round(arc, 2).alias("computed_arc_length_ft"), c["arc"].alias("stated_arc_length_ft"),
            F.round(F.when(c["turn"] == "L", segment).otherwise(-segment), 3).alias("signed_segment_area_sqft"),
            F.when(c["arc"] != 0, F.round(F.abs(arc - c["arc"]), 2)).alias("arc_length_mismatch_ft"),
        ).cast(_CURVE)
        return F.struct(
            F.when(good, F.concat(s["points"], F.array(point))).otherwise(s["points"]).alias("points"),
            F.when(good, chord["tangent_out"]).otherwise(s["tangent"]).alias("tangent"),
            (s["unparsed"] + F.when(good, 0).otherwise(1)).alias("unparsed"),
            (s["i"] + 1).alias("i"),
            F.when(good, F.concat(s["curves"], F.array(note))).otherwise(s["curves"]).alias("curves"),
        )

    def step(s: Column, c: Column) -> Column:
        return F.when(c["curve"], bend(s, c)).otherwise(line(s, c))

    def finish(s: Column) -> Column:
        last = F.element_at(s["points"], -1)
        return F.struct(s["points"].alias("points"), s["unparsed"].alias("unparsed_calls"), F.round(F.hypot(last["x"], last["y"]), 2).alias("closure_error_ft"), s["curves"].alias("curves"))

    return F.aggregate(numbers, start, step, finish)


def walk_traverse(calls: DataFrame, keys: list[str]) -> DataFrame:
    """points, unparsed_calls, closure_error_ft, curves of each parcel.

    Tables of lines only need no fold: a window adds up the steps, and points are gathered as they are.
    """
    read = calls.select(*keys, "seq", read_call(set(calls.columns)).alias("n"))
    if "call_type" in calls.columns:
        gathered = read.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "n"))), lambda x: x["n"]).alias("numbers"))
        return gathered.withColumn("walk", walk_array(F.col("numbers"))).select(*keys, "walk.*")
    n = F.col("n")
    good = n["azimuth"].isNotNull() & n["distance"].isNotNull() & ~n["blank"]
    step = lambda f: F.when(F.col("good"), n["distance"] * f(F.radians(n["azimuth"]))).otherwise(0.0)
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    at = read.withColumn("good", good).withColumns({"x": F.sum(step(F.sin)).over(w), "y": F.sum(step(F.cos)).over(w)})
    points = F.sort_array(F.collect_list(F.when(F.col("good"), F.struct("seq", F.struct("x", "y").alias("p")))))
    walks = at.groupBy(*keys).agg(points.alias("p"), F.count_if(~F.col("good") & ~n["blank"]).cast("int").alias("unparsed_calls"))
    start = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))).cast(f"array<{_POINT}>")
    walks = walks.withColumn("points", F.concat(start, F.transform("p", lambda s: s["p"])))
    last = F.element_at("points", -1)
    return walks.select(*keys, "points", "unparsed_calls", F.round(F.hypot(last["x"], last["y"]), 2).alias("closure_error_ft"), F.array().cast(f"array<{_CURVE}>").alias("curves"))


def walk_lines(vectors: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Running position (x, y) after each line of ``vectors`` (azimuth, distance), by one window."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    dx, dy = F.col("distance") * F.sin(F.radians("azimuth")), F.col("distance") * F.cos(F.radians("azimuth"))
    return vectors.withColumns({"x": F.sum(dx).over(w), "y": F.sum(dy).over(w)})


def closures(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Closure and perimeter of each parcel of straight lines: one aggregation, combined before the shuffle."""
    dx, dy = F.col("distance") * F.sin(F.radians("azimuth")), F.col("distance") * F.cos(F.radians("azimuth"))
    out = vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_calls"), F.sum(dx).alias("east"), F.sum(dy).alias("north"), F.sum("distance").alias("perimeter_ft"))
    out = out.withColumn("closure_error_ft", F.hypot("east", "north"))
    return out.withColumn("precision_ratio", F.when(F.col("closure_error_ft") > 0, F.col("perimeter_ft") / F.col("closure_error_ft")))


def outlier_calls(vectors: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The one call whose removal cuts the closure error most, if by half at least (four calls or more).

    Removing line i leaves the sum of all vectors less its own, so one window over the parcel is enough.
    """
    w = Window.partitionBy(*keys)
    dx, dy = F.col("distance") * F.sin(F.radians("azimuth")), F.col("distance") * F.cos(F.radians("azimuth"))
    v = vectors.withColumns({"_dx": dx, "_dy": dy}).withColumns({"_sx": F.sum("_dx").over(w), "_sy": F.sum("_dy").over(w), "n_calls": F.count(F.lit(1)).over(w)})
    v = v.withColumn("call_index", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    v = v.withColumns({"baseline": F.round(F.hypot("_sx", "_sy"), 2), "without": F.round(F.hypot(F.col("_sx") - F.col("_dx"), F.col("_sy") - F.col("_dy")), 2)})
    best = v.filter((F.col("n_calls") >= 4) & (F.col("baseline") > 0)).groupBy(*keys).agg(F.min(F.struct("without", "call_index", "baseline")).alias("b"))
    gain = (F.col("b.baseline") - F.col("b.without")) / F.col("b.baseline")
    return best.select(*keys, F.col("b.call_index").alias("call_index"), F.col("b.baseline").alias("baseline_closure_ft"), F.col("b.without").alias("closure_without_ft"), F.round(gain, 3).alias("improvement")).filter(gain >= 0.5)


def _bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def _side(e: Column, x: Column, y: Column) -> Column:
    return F.signum((e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"]))


def _within(e: Column, x: Column, y: Column) -> Column:
    return x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))


def segments_touch(e: Column, f: Column) -> Column:
    """Whether segments (ax, ay, bx, by) have a point in common: boxes first, then sides."""
    boxes = (F.greatest(e["ax"], e["bx"]) >= F.least(f["ax"], f["bx"])) & (F.greatest(f["ax"], f["bx"]) >= F.least(e["ax"], e["bx"])) & (F.greatest(e["ay"], e["by"]) >= F.least(f["ay"], f["by"])) & (F.greatest(f["ay"], f["by"]) >= F.least(e["ay"], e["by"]))
    t = F.struct(_side(e, f["ax"], f["ay"]).alias("a"), _side(e, f["bx"], f["by"]).alias("b"), _side(f, e["ax"], e["ay"]).alias("c"), _side(f, e["bx"], e["by"]).alias("d"))

    def sides(t: Column) -> Column:
        on = ((t["a"] == 0) & _within(e, f["ax"], f["ay"])) | ((t["b"] == 0) & _within(e, f["bx"], f["by"])) | ((t["c"] == 0) & _within(f, e["ax"], e["ay"])) | ((t["d"] == 0) & _within(f, e["bx"], e["by"]))
        return ((t["a"] != t["b"]) & (t["c"] != t["d"])) | on

    return F.when(boxes, _bound(t, sides)).otherwise(False)


def crossing_edges(corners: Column) -> Column:
    """(i, j) of the first two edges, not neighbours, that touch; null if there are none or under four corners."""
    nxt = F.concat(F.slice(corners, 2, F.size(corners)), F.slice(corners, 1, 1))
    edges = F.zip_with(corners, nxt, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))

    def search(es: Column) -> Column:
        n = F.size(es)

        def first(e: Column, i: Column) -> Column:
            hits = F.filter(F.transform(F.slice(es, i + 3, n), lambda f, k: F.when(segments_touch(e, f) & ~((i == 0) & (k == n - 3)), i + 2 + k)), lambda j: j.isNotNull())
            return F.struct(i.alias("i"), F.get(hits, 0).alias("j"))

        return F.get(F.filter(F.transform(es, first), lambda s: s["j"].isNotNull()), 0)

    return F.when(F.size(corners) >= 4, _bound(edges, search))


def validate(walks: DataFrame, stated_acres: str = "stated_area_acres", region_text: str = "region_text") -> DataFrame:
    """``walks`` (points, closure_error_ft, curves) and perimeter, precision, area, stated area, flags and ``issues``.

    The last point is dropped as a copy of the first only if the walk really came back (1 ft or 1 % of the
    perimeter).  Areas with curves get their circular segments.  ``valid`` means no issue.
    """
    p = walks.withColumn("perimeter_ft", F.round(G.path_length(F.col("points")), 2))
    ratio = F.when((F.col("closure_error_ft") > 0) & (F.col("perimeter_ft") > 0), F.round(F.col("perimeter_ft") / F.col("closure_error_ft"), 1))
    back = (F.size("points") > 1) & (F.col("closure_error_ft") <= F.greatest(F.lit(1.0), 0.01 * F.col("perimeter_ft")))
    p = p.withColumns({"precision_ratio": ratio, "corners": F.when(back, F.slice("points", 1, F.size("points") - 1)).otherwise(F.col("points"))})
    shape = F.size("corners") >= 3
    bend = F.aggregate("curves", F.lit(0.0), lambda s, c: s + c["signed_segment_area_sqft"])
    area = F.round(F.abs(G.signed_area(F.col("corners")) + bend), 2)
    has = lambda c: F.col(c) if c in walks.columns else F.lit(None).cast("string")
    stated = F.coalesce(F.nullif(T.acres_to_sqft(has(stated_acres)), F.lit(0.0)), T.stated_area_sqft(F.coalesce(has(region_text), F.lit(""))))
    p = p.withColumns({"crossing": F.when(shape, crossing_edges(F.col("corners"))), "area_sqft": F.when(shape, area), "stated_area_sqft": stated})
    off = F.when(F.col("stated_area_sqft") != 0, F.abs(F.col("area_sqft") - F.col("stated_area_sqft")) / F.col("stated_area_sqft"))
    p = p.withColumns({"self_intersects": F.col("crossing").isNotNull(), "area_diff_pct": F.round(off * 100, 2), "area_matches_stated": off <= AREA_TOLERANCE, "area_acres": F.round(F.col("area_sqft") / T.SQFT_PER_ACRE, 3)})
    issues = F.array_compact(F.array(
        F.when(F.col("precision_ratio") < MIN_PRECISION, "weak_closure"),
        F.when(F.col("self_intersects"), "self_intersection"),
        F.when(~shape, "too_few_calls"),
        F.when(~F.col("area_matches_stated"), "area_mismatch"),
    ))
    return p.withColumn("issues", issues).withColumn("valid", F.size("issues") == 0)


def combined_tract(parcels: DataFrame, region: list[str]) -> DataFrame:
    """Flags parcels whose area is that of all stated areas of the region together (two stated areas at least)."""
    w = Window.partitionBy(*region)
    s = F.col("stated_area_sqft")
    p = parcels.withColumns({"stated_sum": F.sum(s).over(w), "stated_n": F.count(s).over(w)})
    return p.withColumn("combined_tract", F.coalesce((F.col("stated_n") >= 2) & (F.abs(F.col("area_sqft") - F.col("stated_sum")) <= AREA_TOLERANCE * F.col("stated_sum")), F.lit(False)))


def axis_conflicts(calls: DataFrame, keys: list[str], order: list[str], tolerance: float = 0.02) -> DataFrame:
    """Neighbouring members of one orientation group (``axis``) whose distances differ by more than 2 %."""
    w = Window.partitionBy(*keys, "axis").orderBy(*order)
    d = calls.withColumn("previous_distance", F.lag("distance").over(w))
    return d.filter(F.abs(F.col("distance") - F.col("previous_distance")) / F.greatest("distance", "previous_distance") > tolerance)


def shared_edges(edges: DataFrame, region: list[str], parcel: str, length_tol: float = 0.02, angle_tol: float = 3.0) -> DataFrame:
    """Best matching edge of each two parcels of a region: lengths within 2 % of the longer, directions opposed within 3 degrees.

    ``edges`` has azimuth, length, seq.  Lengths are binned on a logarithmic scale of step 2 %, so that only edges of
    the same or neighbouring bins of one region meet.
    """
    step = F.log(F.lit(1 + length_tol))
    e = edges.filter("length > 0").withColumn("_bin", F.floor(F.log("length") / step))
    a = e.select(*region, F.col(parcel).alias("parcel_a"), F.col("seq").alias("seq_a"), F.col("azimuth").alias("az_a"), F.col("length").alias("len_a"), F.explode(F.array(F.col("_bin") - 2, F.col("_bin") - 1, F.col("_bin"), F.col("_bin") + 1, F.col("_bin") + 2)).alias("_bin"))
    b = e.select(*region, F.col(parcel).alias("parcel_b"), F.col("seq").alias("seq_b"), F.col("azimuth").alias("az_b"), F.col("length").alias("len_b"), "_bin")
    turn = G.circular_diff(F.col("az_a") + 180, F.col("az_b"), 360.0)
    rel = F.abs(F.col("len_a") - F.col("len_b")) / F.greatest("len_a", "len_b")
    pairs = a.join(b, [*region, "_bin"]).filter((F.col("parcel_a") < F.col("parcel_b")) & (rel <= length_tol) & (turn <= angle_tol))
    score = F.struct((F.abs(F.col("len_a") - F.col("len_b")) + turn).alias("score"), "seq_a", "seq_b")
    return pairs.groupBy(*region, "parcel_a", "parcel_b").agg(F.min(score).alias("best")).select(*region, "parcel_a", "parcel_b", "best.*")


def align_to_edge(points: Column, a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """``points`` of B moved by the mean offset that brings its edge b1-b2 onto A's edge a1-a2, walked the other way."""
    dx = ((a1["x"] - b2["x"]) + (a2["x"] - b1["x"])) / 2
    dy = ((a1["y"] - b2["y"]) + (a2["y"] - b1["y"])) / 2
    return G.translate_ring(points, dx, dy)


def local_geojson(walks: DataFrame) -> DataFrame:
    """``feature``: a closed local polygon in feet, two decimals."""
    ring = G.round_ring(G.close_ring(F.col("points")), 2)
    coordinates = F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("closure_error_ft", "unparsed_calls").alias("properties"), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"))
    return walks.withColumn("feature", F.to_json(feature))
