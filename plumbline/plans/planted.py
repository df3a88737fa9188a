"""Registered queries whose rows are survey cases made from the driver's tables, with the outcome that was planted as SQL.

Each row of a table becomes one case (a sheet with control points, a parcel among neighbours, a payload, a text); the operator
has to find what the row's keys say.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import confirm, evidence, legal, outline, payloads, placement, search, sheets, views
from ..streaming import progress
from .queries import load, query


def _xy(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _place(p: Column, scale: float, rotation: Column) -> Column:
    """Ground position (east, north) of a pixel, the page's origin being at 5000, 9000."""
    return G.pixel_place(p["x"], p["y"], F.lit(0.0), F.lit(0.0), F.lit(5000.0), F.lit(9000.0), rotation, F.lit(scale))


# placement


@query("control_points", """SELECT c_custkey, CASE c_custkey % 4 WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'unverified' ELSE 'validated' END AS status, CASE WHEN c_custkey % 4 < 2 THEN 0 END AS vertex_of_first, CASE WHEN c_custkey % 4 < 2 THEN 2 END AS vertex_of_second,
 CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 3 THEN 0 ELSE 2 END AS readings, CASE WHEN c_custkey % 4 < 2 THEN CAST(c_custkey * 7 % 360 AS DOUBLE) END AS rotation_deg, CASE WHEN c_custkey % 4 < 2 THEN CAST(floor(round(0.5 * sqrt((1000 + c_custkey % 500) ** 2 + (300 + c_custkey % 200) ** 2), 2)) AS BIGINT) END AS separation_ft FROM customer""")
def control_points(spark, d):
    """Every customer a sheet: a rectangle and the printed positions of two opposite corners.

    Its turn is known; or up to half a turn, with labels at the corners or without any; or the printed distance is wrong.
    """
    k = F.col("c_custkey")
    w, h = 1000 + k % 500, 300 + k % 200
    ring = F.array(_xy(F.lit(0), F.lit(0)), _xy(w, F.lit(0)), _xy(w, h), _xy(F.lit(0), h))
    turn = (k * 7 % 360).cast("double")
    # 5 % too far out in every fourth sheet
    out = lambda v, o: F.when(k % 4 == 3, o + (v - o) * 1.05).otherwise(v)
    place = lambda i: _place(F.get("vertices", i), 0.5, F.col("turn"))
    point = lambda i: F.struct(out(place(i)["x"], F.lit(5000.0)).alias("easting"), out(place(i)["y"], F.lit(9000.0)).alias("northing"), F.when(k % 4 != 2, F.get("vertices", i)).alias("label_px"))
    c = load(spark, d, "customer").select("c_custkey", ring.alias("vertices"), turn.alias("turn"))
    c = c.withColumn("points", F.array(point(0), point(2))).withColumns({"scale_ft_per_px": F.lit(0.5), "rotations": F.when((k % 4).isin(1, 2), F.array((F.col("turn") + 180) % 360, "turn")).otherwise(F.array("turn"))})
    s = placement.control_solutions(c, ["c_custkey"])
    of = lambda p: F.when(F.col("anchor_point") == p, F.col("anchor_vertex")).otherwise(F.col("other_vertex"))
    return s.select("c_custkey", "status", of(0).alias("vertex_of_first"), of(1).alias("vertex_of_second"), F.col("correspondences").alias("readings"), F.round("rotation_deg", 6).alias("rotation_deg"), F.floor("separation_ft").alias("separation_ft"))


@query("apn_fit", "SELECT n_nationkey, CAST(20 - n_nationkey % 5 * 10 AS BIGINT) AS east_m, CAST(25 - n_nationkey % 3 * 25 AS BIGINT) AS north_m, 0.0 AS rotation_deg, true AS corroborated FROM nation")
def apn_fit(spark, d):
    """Every nation a sheet: three lots, moved by a known way out of the gap between six neighbours."""
    k = F.col("n_nationkey")
    lat = F.lit(39.6)
    kx = G.M_PER_DEG_LON * F.cos(F.radians(lat))
    box = lambda x, y, w, h: F.array(*(_xy(F.lit(-119.8) + a / kx, lat + b / G.M_PER_DEG_LAT) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))))
    dx, dy = k % 5 * 10 - 20, k % 3 * 25 - 25
    lots = F.array(*(box(30 * i + dx, 0 + dy, 30, 50) for i in range(3)))
    around = F.array(*(box(F.lit(x), F.lit(y), F.lit(w), F.lit(h)) for x, y, w, h in ((-60, 0, 60, 50), (90, 0, 60, 50), (-60, 50, 105, 40), (45, 50, 105, 40), (-60, -40, 105, 40), (45, -40, 105, 40))))
    s = load(spark, d, "nation").select("n_nationkey", lots.alias("rings"), around.alias("neighbours"), F.lit(None).cast("array<struct<x:double,y:double>>").alias("target")).repartition("n_nationkey")
    f = placement.apn_fits(s, ["n_nationkey"])
    return f.select("n_nationkey", F.round("east_m").cast("long").alias("east_m"), F.round("north_m").cast("long").alias("north_m"), "rotation_deg", "corroborated")


@query("borrow_call", """SELECT c_custkey, CAST(CASE WHEN c_custkey % 4 = 3 THEN 3 ELSE 4 END AS INTEGER) AS n_calls, c_custkey % 4 IN (1, 2) AS borrowed FROM customer""")
def borrow_call(spark, d):
    """Every customer a region of two lots: the first lacks a side that the second has (as it is, reversed, or not at all)."""
    k = F.col("c_custkey")
    side = F.format_string("%.2f", 100.0 + k % 300)
    call = lambda b: F.struct(F.lit(b).alias("bearing"), side.alias("distance"))
    three = [call("N0°00'00\"E"), call("N90°00'00\"E"), call("S0°00'00\"E")]
    own = F.when(k % 4 == 0, F.array(*three, call("S90°00'00\"W"))).otherwise(F.array(*three))
    other = F.when(k % 4 == 1, F.array(call("S90°00'00\"W"))).when(k % 4 == 2, F.array(call("N90°00'00\"E"))).otherwise(F.array(call("N45°00'00\"E")))
    area = F.pow(100.0 + k % 300, 2)
    lots = F.array(F.struct(F.lit(0).alias("parcel_index"), F.lit("A").alias("label"), own.alias("calls"), area.alias("stated_area_sqft"), (k % 4 == 0).alias("valid")), F.struct(F.lit(1).alias("parcel_index"), F.lit("B").alias("label"), other.alias("calls"), F.lit(None).cast("double").alias("stated_area_sqft"), F.lit(True).alias("valid")))
    p = load(spark, d, "customer").select("c_custkey", F.explode(lots).alias("p")).select("c_custkey", "p.*")
    b = search.borrow_frame(p, ["c_custkey"]).filter("parcel_index = 0")
    return b.select("c_custkey", F.size("calls").alias("n_calls"), F.col("note").isNotNull().alias("borrowed"))


@query("assembled_lots", "SELECT c_custkey, CAST(4 AS INTEGER) AS n_calls, CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_notes, round(power(100 + c_custkey % 300, 2) * 2, 2) AS area FROM customer")
def assembled_lots(spark, d):
    """Every customer a lot whose calls are as they should be, or walked from the wrong end, or with a line that is not its own."""
    k = F.col("c_custkey")
    n = 100.0 + k % 300
    call = lambda b, f: F.struct(F.lit(b).alias("bearing"), F.format_string("%.2f", n * f).alias("distance"))
    good = [call("N0°00'00\"E", 1), call("N90°00'00\"E", 2), call("S0°00'00\"E", 1), call("S90°00'00\"W", 2)]
    calls = F.when(k % 3 == 0, F.array(*good)).when(k % 3 == 1, F.array(good[0], call("S90°00'00\"W", 2), *good[2:])).otherwise(F.array(*good[:2], call("N33°00'00\"E", 0.7), *good[2:]))
    none = F.array().cast("array<struct<bearing:string,distance:string>>")
    p = load(spark, d, "customer").select("c_custkey", calls.alias("calls"), none.alias("alternates"), (n * n * 2).alias("stated_area_sqft"), F.array().cast("array<double>").alias("sibling_sqfts"))
    r = search.repair_frame(p, ["c_custkey"])
    az, far = lambda c: F.radians(T.azimuth(c["bearing"])), lambda c: T.distance(c["distance"])
    step = F.transform("calls", lambda c: F.struct((far(c) * F.sin(az(c))).alias("x"), (far(c) * F.cos(az(c))).alias("y")))
    # a column each, or each corner would read all calls' texts again
    r = r.withColumn("step", step)
    corners = F.transform("step", lambda s, i: F.aggregate(F.slice("step", F.lit(1), i + 1), _xy(F.lit(0), F.lit(0)), lambda a, b: _xy(a["x"] + b["x"], a["y"] + b["y"])))
    r = r.withColumn("corners", corners)
    return r.select("c_custkey", F.size("calls").alias("n_calls"), F.size("notes").alias("n_notes"), F.round(G.ring_area(F.col("corners")), 2).alias("area"))


@query("area_check", """SELECT o_orderkey, round(o_totalprice, 2) AS area_sqft, CASE WHEN o_custkey % 5 > 0 THEN round(abs(o_totalprice - o_custkey * 997) / (o_custkey * 997) * 100, 2) END AS area_diff_pct,
 CASE WHEN o_custkey % 5 > 0 THEN abs(o_totalprice - o_custkey * 997) / (o_custkey * 997) <= 0.15 END AS area_matches_stated FROM orders""")
def area_check(spark, d):
    stated = F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey") * 997.0)
    return load(spark, d, "orders").select("o_orderkey", confirm.area_check(F.col("o_totalprice"), stated).alias("c")).select("o_orderkey", "c.area_sqft", "c.area_diff_pct", "c.area_matches_stated")


@query("crop_box", """WITH r AS (SELECT p_partkey, p_partkey % 2 = 0 AS drawing, CAST(p_partkey * 13 % 1000 AS DOUBLE) AS x, CAST(p_partkey * 7 % 800 AS DOUBLE) AS y, CAST(100 + p_size * 20 AS DOUBLE) AS w, CAST(50 + p_size * 9 AS DOUBLE) AS h FROM part),
m AS (SELECT *, CASE WHEN drawing THEN greatest(40.0, w * 0.08) ELSE 0 END AS mx, CASE WHEN drawing THEN greatest(40.0, h * 0.08) ELSE 0 END AS my FROM r)
SELECT p_partkey, round(greatest(0, x - mx), 6) AS x, round(greatest(0, y - my), 6) AS y, round(least(1500, x + w + mx) - greatest(0, x - mx), 6) AS w, round(least(1200, y + h + my) - greatest(0, y - my), 6) AS h FROM m""")
def crop_box(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    bbox = F.struct((k * 13 % 1000).cast("double").alias("x"), (k * 7 % 800).cast("double").alias("y"), (100 + size * 20).cast("double").alias("w"), (50 + size * 9).cast("double").alias("h"))
    region = F.struct(F.when(k % 2 == 0, "ParcelMap").otherwise("Text").alias("class"), bbox.alias("bbox"))
    c = load(spark, d, "part").select("p_partkey", confirm.crop_box(region, F.lit(1500.0), F.lit(1200.0)).alias("c"))
    return c.select("p_partkey", *(F.round(f"c.{a}", 6).alias(a) for a in "xywh"))


@query("feature_offsets", """WITH f AS (SELECT e.event_id, e.event_id % 400 AS x1, e.event_id * 3 % 300 AS y1, e.event_id * 7 % 500 AS x2, e.event_id * 11 % 350 AS y2, e.event_id % 4 AS s FROM events e),
t AS (SELECT *, abs(degrees(atan2(y2 - y1, x2 - x1))) % 180 AS tilt FROM f)
SELECT event_id, CASE WHEN s < 2 THEN round(CASE WHEN y1 = y2 THEN x1 ELSE x1 + (x2 - x1) * (150.0 - y1) / (y2 - y1) END - CASE WHEN s = 0 THEN 300 ELSE 100 END, 6) END AS dx_px,
 CASE WHEN s >= 2 THEN round(CASE WHEN x1 = x2 THEN y1 ELSE y1 + (y2 - y1) * (200.0 - x1) / (x2 - x1) END - CASE WHEN s = 3 THEN 200 ELSE 100 END, 6) END AS dy_px
FROM t WHERE CASE WHEN s < 2 THEN abs(tilt - 90) ELSE least(tilt, 180 - tilt) END <= 25""")
def feature_offsets(spark, d):
    e = F.col("event_id")
    side = F.when(e % 4 == 0, "east").when(e % 4 == 1, "west").when(e % 4 == 2, "north").otherwise("south")
    f = load(spark, d, "events").select("event_id", side.alias("side"), *((c.cast("double")).alias(n) for n, c in (("x1", e % 400), ("y1", e * 3 % 300), ("x2", e * 7 % 500), ("y2", e * 11 % 350))))
    boxes = f.select("event_id", F.lit(100.0).alias("left"), F.lit(100.0).alias("top"), F.lit(300.0).alias("right"), F.lit(200.0).alias("bottom"))
    return views.feature_offsets(f, boxes, ["event_id"]).select("event_id", F.round("dx_px", 6).alias("dx_px"), F.round("dy_px", 6).alias("dy_px"))


@query("curve_edits", """SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN '1:0.4' ELSE '0:0.2' END AS curves_left FROM customer""")
def curve_edits(spark, d):
    """Curves on edges 0 and 2 of a square, after corner c_custkey % 4 goes."""
    way = lambda b: F.array(F.struct(F.lit(0.5).alias("a"), F.lit(b).alias("b")))
    curves = F.create_map(F.lit(0), way(0.2), F.lit(2), way(0.4))
    left = F.map_entries(outline.curves_after_delete(curves, (F.col("c_custkey") % 4).cast("int"), F.lit(4)))
    named = F.array_join(F.array_sort(F.transform(left, lambda e: F.concat_ws(":", e["key"], F.get(e["value"], 0)["b"]))), "|")
    return load(spark, d, "customer").select("c_custkey", named.alias("curves_left"))


# texts and payloads


@query("legal_descriptions", "SELECT c_custkey, CAST(4 AS INTEGER) AS n_calls, CAST(c_custkey % 90 + 1 AS VARCHAR) || '.5' AS acres FROM customer WHERE c_custkey % 3 <> 1")
def legal_descriptions(spark, d):
    """Every customer a written boundary, a third of which does not close."""
    k = F.col("c_custkey")
    side, last = F.format_string("%d.25", 100 + k % 700), F.format_string("%d.25", 100 + k % 700 + F.when(k % 3 == 1, 50).otherwise(0))
    line = lambda ns, deg, ew, d: F.concat(F.lit(f" thence {ns} {deg}°00'00\" {ew}, "), d, F.lit(" feet;"))
    text = F.concat(F.lit("COMMENCING at a monument; to the POINT OF BEGINNING;"), line("N", "10", "E", side), line("S", "80", "E", side), line("S", "10", "W", side), line("N", "80", "W", last), F.lit(" to the point of beginning, CONTAINING "), F.format_string("%d.5", k % 90 + 1), F.lit(" ACRES more or less."))
    out = legal.parse_legal_descriptions(load(spark, d, "customer").select(k.alias("document_id"), text.alias("text")))
    return out.select(F.col("document_id").alias("c_custkey"), F.size("calls").alias("n_calls"), F.col("stated_area_acres").alias("acres"))


@query("sanitize_location", """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'subject' ELSE 'referenced' END AS role, CASE WHEN s_suppkey % 2 = 0 THEN 'NE' END AS side, s_suppkey % 4 <> 0 AS has_coordinate, CASE WHEN s_suppkey % 5 = 0 THEN 1.0002 END AS factor, 'Washoe' AS county FROM supplier""")
def sanitize_location(spark, d):
    """Every supplier a model's answer, with roles, sides, coordinates and factors that are plausible or not."""
    k = F.col("s_suppkey")
    text = F.format_string('{"apns":[{"apn":"123-45%d-67","role":"%s","side":"%s"},{"apn":"12"}],"coordinates":[{"northing":%s,"easting":2289281.05,"kind":"monument"}],"coordinate_system":{"combined_factor":%s},"county":" Washoe ","state":"N/A"}',
                           k % 10, F.when(k % 3 == 0, "subject").otherwise("owner"), F.when(k % 2 == 0, "ne").otherwise("up"), F.when(k % 4 != 0, "14834576.92").otherwise("12"), F.when(k % 5 == 0, "1.0002").otherwise("3.5"))
    e = load(spark, d, "supplier").select("s_suppkey", evidence.sanitize_location(text).alias("e"))
    first = F.get("e.apns", 0)
    return e.select("s_suppkey", first["role"].alias("role"), first["side"].alias("side"), (F.size("e.coordinates") == 1).alias("has_coordinate"), F.col("e.coordinate_system.combined_factor").alias("factor"), F.col("e.county").alias("county"))


@query("printed_evidence", """SELECT o_orderkey, o_orderkey % 2 = 0 AS number, o_orderkey % 3 = 0 AS apn, o_orderkey % 5 <> 0 AS words FROM orders""")
def printed_evidence(spark, d):
    """Whether a number, a parcel number and a name of each order are printed in a text made for it."""
    o = F.col("o_orderkey")
    number = (10_000_000 + o).cast("double")
    apn = F.format_string("%03d-%03d-%02d", o % 900 + 100, o * 7 % 900 + 100, o % 90 + 10)
    text = F.concat(
        F.when(o % 2 == 0, F.concat(F.lit("N "), F.format_number(number, 0), F.lit(".25 "))).otherwise("N none "),
        F.when(o % 3 == 0, F.concat(F.lit("APN "), F.replace(apn, F.lit("-"), F.lit(" ")))).otherwise("APN 1-2-3"),
        F.when(o % 5 != 0, " the TRUCKEE meadows").otherwise(" elsewhere"),
    )
    return load(spark, d, "orders").select("o_orderkey", T.printed_number(number, text).alias("number"), T.printed_apn(apn, text).alias("apn"), T.printed_words(F.lit("The Truckee Meadows"), text).alias("words"))


@query("edge_labels", """SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 6 < 4 THEN 1 ELSE 0 END AS INTEGER) AS n, CASE WHEN p_partkey % 2 = 0 THEN round(p_partkey % 90 + 0.5, 6) END AS azimuth FROM part""")
def edge_labels(spark, d):
    """Every part a model's answer about the edges of a square: one with a NUL for its degree sign, one maybe out of range."""
    k = F.col("p_partkey")
    text = F.format_string('{"edges":[{"edge_index":0,"distance_ft":%s,"bearing_text":"N %d\\u000030\'00\\" E"},{"edge_index":%d,"distance_ft":12.5}]}', F.when(k % 2 == 0, "100.25").otherwise("true"), k % 90, k % 6)
    e = load(spark, d, "part").select("p_partkey", payloads.edge_labels(text, F.lit(4)).alias("e"))
    return e.select("p_partkey", F.size("e").alias("n"), F.round(F.get(F.filter("e", lambda x: x["azimuth"].isNotNull()), 0)["azimuth"], 6).alias("azimuth"))


@query("sheet_roles", """SELECT c_custkey, CAST(c_custkey % 2 AS INTEGER) AS image, CASE WHEN c_custkey % 3 = 0 THEN 'target_parcel_map' ELSE 'not_a_map' END AS role FROM customer WHERE c_custkey % 5 > 0""")
def sheet_roles(spark, d):
    """Every customer an answer about two sheets, where one role is unknown and one sheet does not exist; a fifth are no JSON."""
    k = F.col("c_custkey")
    text = F.when(k % 5 > 0, F.format_string('[{"image_number":%d,"role":"%s"},{"image_number":9,"role":"not_a_map"},{"image_number":%d,"role":"poem"}]', k % 2 + 1, F.when(k % 3 == 0, "target_parcel_map").otherwise("not_a_map"), 2 - k % 2)).otherwise("no answer")
    r = payloads.sheet_roles(load(spark, d, "customer").select("c_custkey", text.alias("payload"), F.lit(2).alias("count")))
    return r.select("c_custkey", "image", "role")


@query("stated_acres", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, round(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity WHEN l_linenumber % 3 = 1 THEN l_extendedprice / 43560 ELSE l_partkey % 40 + 0.25 END, 9) AS acres FROM lineitem""")
def stated_acres(spark, d):
    """As extracted, as corrected on the listed parcel, or as its text reads."""
    n = F.col("l_linenumber") % 3
    entity = F.struct(F.when(n == 1, F.col("l_extendedprice")).alias("stated_area_sqft"), F.format_string("%d.25 ACRES", F.col("l_partkey") % 40).alias("stated_area"))
    return load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", F.round(views.stated_acres(F.when(n == 0, F.col("l_quantity")), entity), 9).alias("acres"))


# copies, queues and windows


@query("word_subset_dedupe", """WITH r AS (SELECT p_partkey, p_brand, p_partkey % 2 = 0 AS target, string_split(upper(p_name), ' ') AS w, CASE WHEN p_size % 7 > 0 THEN CAST(p_size AS DOUBLE) END AS acres FROM part)
SELECT a.p_partkey FROM r a WHERE NOT a.target AND EXISTS (SELECT 1 FROM r b WHERE b.target AND b.p_brand = a.p_brand AND (list_has_all(a.w, b.w) OR list_has_all(b.w, a.w)) AND coalesce(abs(a.acres - b.acres) <= 0.08 * greatest(a.acres, b.acres), true))""")
def word_subset_dedupe(spark, d):
    """Parts of odd keys whose name is contained in, or contains, that of an even part of the same brand and about the same size."""
    k = F.col("p_partkey")
    refs = load(spark, d, "part").select(F.col("p_brand").alias("document_id"), F.lit(1).alias("page_number"), k.alias("id"), F.col("p_name").alias("label"), F.when(F.col("p_size") % 7 > 0, F.col("p_size").cast("double")).alias("acres"), F.when(k % 2 == 0, "target_parcel_map").otherwise("reference_survey").alias("role"))
    return views.other_sheet_copies(refs).select(F.col("id").alias("p_partkey"))


@query("orphan_requeue", """SELECT event_id, user_id FROM events e WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'click' AND r.user_id = e.user_id AND CAST(r.ts AS DATE) = CAST(e.ts AS DATE))""")
def orphan_requeue(spark, d):
    """Purchases of a user and day that no click stands for."""
    e = load(spark, d, "events").withColumn("day", F.to_date("ts"))
    return progress.orphans(e.filter("event_type = 'purchase'"), e.filter("event_type = 'click'").select("user_id", "day"), ["user_id", "day"]).select("event_id", "user_id")


@query("sliding_window", """SELECT strftime(time_bucket(INTERVAL '15 minutes', ts) - i * INTERVAL '15 minutes', '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events, unnest(generate_series(0, 3)) AS u(i) GROUP BY 1, 2""")
def sliding_window(spark, d):
    """Events of an hour, every 15 minutes: the streaming counts over a table that is at rest."""
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return progress.stream_counts(e, "ts", "event_type", "1 hour", "15 minutes").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("token_budget", """SELECT event_id, CAST(sum(floor(value)) OVER w AS BIGINT) AS tokens_in_window, sum(floor(value)) OVER w <= 3000 OR count(*) OVER w = 1 AS allowed FROM events WINDOW w AS (PARTITION BY event_type ORDER BY epoch(ts) RANGE BETWEEN 600 PRECEDING AND CURRENT ROW)""")
def token_budget(spark, d):
    e = load(spark, d, "events").withColumn("tokens", F.floor("value"))
    return progress.token_window(e, ["event_type"], "ts", "tokens", 600, 3000).select("event_id", "tokens_in_window", "allowed")


@query("utm_zone", """SELECT c_custkey, CAST(CASE WHEN (c_custkey * 53 % 160) - 80 >= 0 THEN 32600 ELSE 32700 END + floor((c_custkey * 37 % 360) / 6) + 1 AS INTEGER) AS epsg FROM customer""")
def utm_zone(spark, d):
    k = F.col("c_custkey")
    return load(spark, d, "customer").select("c_custkey", G.utm_epsg(k * 37 % 360 - 180.0, k * 53 % 160 - 80.0).cast("int").alias("epsg"))


@query("boundary_refs", """SELECT c.c_custkey, o.o_orderkey, c.c_mktsegment AS label FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderkey % 3 > 0 UNION ALL SELECT NULL, o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 3 = 0""")
def boundary_refs(spark, d):
    """Customers as listed parcels, orders as drawings of which a third belong to no listed one."""
    page = [F.lit("d").alias("document_id"), F.lit(1).alias("page_number")]
    o = F.col("o_orderkey")
    drawn = load(spark, d, "orders").select(*page, F.concat(F.lit("o"), o).alias("id"), F.when(o % 3 > 0, F.concat(F.lit("c"), F.col("o_custkey"))).alias("roster_id"), F.col("o_orderpriority").alias("label"), F.lit(0).alias("region_index"), o.alias("parcel_index"), F.lit(1.0).alias("region_area"), F.lit(True).alias("human_confirmed"))
    listed = load(spark, d, "customer").select(*page, F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), F.lit(None).cast("string").alias("excluded_reason"))
    sheet = spark.range(1).select(*page, F.lit("target_parcel_map").alias("role"))
    r = views.boundary_refs(drawn, listed, sheet)
    return r.select(F.when(F.col("listed"), F.substring("id", 2, 20).cast("long")).alias("c_custkey"), F.col("parcel_index").alias("o_orderkey"), "label")


@query("tiles_cover", """SELECT p_partkey, CAST(ceil((700 + p_size * 40) / 600.0) * ceil((500 + p_size * 30) / 600.0) AS BIGINT) AS tiles FROM part""")
def tiles_cover(spark, d):
    pages = load(spark, d, "part").select("p_partkey", (700 + F.col("p_size") * 40).alias("width"), (500 + F.col("p_size") * 30).alias("height"))
    return sheets.tiles(pages, 700, 100).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("tiles"))


@query("self_crossings", """WITH c AS (SELECT o_orderkey FROM orders) SELECT o_orderkey, o_orderkey % 2 = 1 AS crosses FROM c""")
def self_crossings(spark, d):
    """Every order a quadrilateral, every other one a bow tie."""
    from ..operators import cogo

    o = F.col("o_orderkey")
    w, h = o % 50 + 10, o % 30 + 5
    ring = F.when(o % 2 == 1, F.array(_xy(F.lit(0), F.lit(0)), _xy(w, h), _xy(w, F.lit(0)), _xy(F.lit(0), h))).otherwise(F.array(_xy(F.lit(0), F.lit(0)), _xy(w, F.lit(0)), _xy(w, h), _xy(F.lit(0), h)))
    return load(spark, d, "orders").select("o_orderkey", cogo.crossing_edges(ring).isNotNull().alias("crosses"))


@query("drop_conflicts", """SELECT c_custkey, concat_ws('|', 'N0°00''00"E ' || printf('%.2f', 100.0 + c_custkey % 300), 'N90°00''00"E ' || printf('%.2f', 100.0 + c_custkey % 300), 'S0°00''00"E ' || printf('%.2f', 100.0 + c_custkey % 300), 'S90°00''00"W ' || printf('%.2f', 100.0 + c_custkey % 300)) AS kept FROM customer""")
def drop_conflicts(spark, d):
    """Every customer a lot with one side read twice, 10 % apart, the wrong reading first or second: the one that closes stays."""
    k = F.col("c_custkey")
    n = 100.0 + k % 300
    call = lambda b, f: F.struct(F.lit(b).alias("bearing"), F.format_string("%.2f", n * f).alias("distance"))
    first, second = (F.when(k % 2 == 0, x).otherwise(y) for x, y in ((1.0, 1.1), (1.1, 1.0)))
    calls = F.array(call("N0°00'00\"E", first), call("N0°00'00\"E", second), call("N90°00'00\"E", 1), call("S0°00'00\"E", 1), call("S90°00'00\"W", 1))
    none = F.array().cast("array<struct<bearing:string,distance:string>>")
    p = load(spark, d, "customer").select("c_custkey", calls.alias("calls"), none.alias("alternates"), F.lit(None).cast("double").alias("stated_area_sqft"), F.array().cast("array<double>").alias("sibling_sqfts"))
    return search.repair_frame(p, ["c_custkey"]).select("c_custkey", F.array_join(F.transform("calls", lambda c: F.concat_ws(" ", c["bearing"], c["distance"])), "|").alias("kept"))


