"""Registered queries: every operator family applied to the driver's tables, with the same thing in DuckDB SQL.

An adapter reads driver tables as survey tables (order lines as calls, order values as vertices, events as progress ...), the
operator does the work, and the SQL says what must come out.  Where SQL cannot say it, there is none and tests
compare with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geodesy as E
from ..functions import geometry as G
from ..functions import text as T
from ..operators import cogo, evidence, matching, outline, placement, report, search, sheets, status
from ..sources.tables import lineitem_calls
from ..streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def load(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def calls(spark: SparkSession, d: str) -> DataFrame:
    return lineitem_calls(load(spark, d, "lineitem"))


CALLS = """calls AS (SELECT l_orderkey AS parcel_key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq,
  CAST((l_partkey * 7) % 360 AS DOUBLE) AS azimuth, l_quantity AS distance, l_extendedprice / 1000 AS y FROM lineitem)"""
STEP = "distance * sin(radians(azimuth)) AS dx, distance * cos(radians(azimuth)) AS dy"

# walks


@query("closure_report", f"""WITH {CALLS}, v AS (SELECT *, {STEP} FROM calls), s AS (SELECT parcel_key, count(*) AS n_calls, sum(dx) AS e, sum(dy) AS n, sum(distance) AS p FROM v GROUP BY 1)
SELECT parcel_key, n_calls, round(sqrt(e*e + n*n), 4) AS closure_error_ft, round(p, 2) AS perimeter_ft, n_calls >= 3 AND sqrt(e*e + n*n) <= 0.01 * p AS closes FROM s""")
def closure_report(spark, d):
    c = cogo.closures(lineitem_calls(load(spark, d, "lineitem")).drop("seq"), ["parcel_key"])
    closes = (F.col("n_calls") >= 3) & (F.col("closure_error_ft") <= cogo.CLOSED_RATIO * F.col("perimeter_ft"))
    return c.select("parcel_key", "n_calls", F.round("closure_error_ft", 4).alias("closure_error_ft"), F.round("perimeter_ft", 2).alias("perimeter_ft"), closes.alias("closes"))


@query("traverse_walk", f"""WITH {CALLS}, v AS (SELECT *, {STEP} FROM calls)
SELECT parcel_key, seq, round(sum(dx) OVER w, 4) + 0.0 AS x, round(sum(dy) OVER w, 4) + 0.0 AS y FROM v WINDOW w AS (PARTITION BY parcel_key ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def traverse_walk(spark, d):
    w = cogo.walk_lines(calls(spark, d), ["parcel_key"], ["seq"])
    return w.select("parcel_key", F.col("seq").cast("long").alias("seq"), (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


def text_calls(spark, d) -> DataFrame:
    """Calls with printed bearings and distances."""
    az = F.col("azimuth")
    q = F.when(az <= 90, az).when(az <= 180, 180 - az).when(az <= 270, az - 180).otherwise(360 - az)
    ns, ew = F.when((az <= 90) | (az > 270), "N").otherwise("S"), F.when(az <= 180, "E").otherwise("W")
    return calls(spark, d).select("parcel_key", "seq", F.format_string("%s %02d°00'00\"%s", ns, q.cast("int"), ew).alias("bearing"), F.format_string("%.2f'", "distance").alias("distance"))


VALID = f"""WITH {CALLS}, v AS (SELECT *, {STEP} FROM calls),
p AS (SELECT parcel_key, seq, distance, sum(dx) OVER w AS x, sum(dy) OVER w AS y FROM v WINDOW w AS (PARTITION BY parcel_key ORDER BY seq ROWS UNBOUNDED PRECEDING)),
s AS (SELECT parcel_key, count(*) AS n, round(sum(distance), 2) AS perimeter_ft, arg_max(x, seq) AS lx, arg_max(y, seq) AS ly FROM p GROUP BY 1),
g AS (SELECT *, round(sqrt(lx*lx + ly*ly), 2) AS gap FROM s), f AS (SELECT *, gap <= greatest(1.0, 0.01 * perimeter_ft) AS back FROM g),
o AS (SELECT parcel_key, 0 AS seq, 0.0 AS x, 0.0 AS y FROM s UNION ALL SELECT p.parcel_key, p.seq, p.x, p.y FROM p JOIN f USING (parcel_key) WHERE NOT (back AND p.seq = n)),
e AS (SELECT parcel_key, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM o WINDOW w AS (PARTITION BY parcel_key ORDER BY seq)),
a AS (SELECT parcel_key, count(*) AS corners, abs(sum(x * y2 - x2 * y)) / 2 AS area FROM e GROUP BY 1)
SELECT parcel_key, CAST(n + 1 AS BIGINT) AS n_points, gap AS closure_error_ft, perimeter_ft, CASE WHEN corners >= 3 THEN round(area, 2) END AS area_sqft,
  coalesce(gap > 0 AND round(perimeter_ft / gap, 1) < 2000, false) AS weak_closure, corners < 3 AS too_few_calls FROM f JOIN a USING (parcel_key)"""


@query("validate_traverse", VALID)
def validate_traverse(spark, d):
    v = cogo.validate(cogo.walk_traverse(text_calls(spark, d), ["parcel_key"]))
    return v.select("parcel_key", F.size("points").cast("long").alias("n_points"), "closure_error_ft", "perimeter_ft", "area_sqft", F.array_contains("issues", "weak_closure").alias("weak_closure"), F.array_contains("issues", "too_few_calls").alias("too_few_calls"))


@query("self_intersection")
def self_intersection(spark, d):
    v = cogo.validate(cogo.walk_traverse(text_calls(spark, d), ["parcel_key"]))
    return v.select("parcel_key", "self_intersects", F.col("crossing.i").alias("edge_a"), F.col("crossing.j").alias("edge_b"))


RING = "ring AS (SELECT l_orderkey AS parcel_key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem)"


def rings(spark, d) -> DataFrame:
    li = load(spark, d, "lineitem")
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.struct(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y")).alias("p"))
    return li.groupBy(F.col("l_orderkey").alias("parcel_key")).agg(F.transform(F.sort_array(F.collect_list(key)), lambda s: s["p"]).alias("ring"))


@query("shoelace_area", f"""WITH {RING}, e AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM ring WINDOW w AS (PARTITION BY parcel_key ORDER BY seq))
SELECT parcel_key, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN abs(sum(x * y2 - x2 * y)) / 2 ELSE 0 END, 3) AS area FROM e GROUP BY 1""")
def shoelace_area(spark, d):
    return rings(spark, d).select("parcel_key", F.size("ring").cast("long").alias("n"), F.round(G.ring_area(F.col("ring")), 3).alias("area"))


@query("perimeter_lead", f"""WITH {RING}, e AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM ring WINDOW w AS (PARTITION BY parcel_key ORDER BY seq))
SELECT parcel_key, round(coalesce(sum(sqrt((x2-x)*(x2-x) + (y2-y)*(y2-y))), 0), 4) AS perimeter FROM e GROUP BY 1""")
def perimeter_lead(spark, d):
    return rings(spark, d).select("parcel_key", F.round(G.path_length(F.col("ring")), 4).alias("perimeter"))


@query("vertex_centroid", """SELECT l_orderkey AS parcel_key, round(avg(l_quantity), 8) AS x, round(avg(l_extendedprice / 1000), 8) AS y FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER w AS r,
 first_value(l_quantity) OVER w AS fx, first_value(l_extendedprice) OVER w AS fy FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) WHERE NOT (n > 1 AND r = n AND l_quantity = fx AND l_extendedprice / 1000 = fy / 1000) GROUP BY 1""")
def vertex_centroid(spark, d):
    c = rings(spark, d).withColumn("c", G.vertex_mean(F.col("ring")))
    return c.select("parcel_key", F.round("c.x", 8).alias("x"), F.round("c.y", 8).alias("y"))


@query("outlier_call", f"""WITH {CALLS}, v AS (SELECT *, {STEP} FROM calls),
s AS (SELECT *, count(*) OVER w AS n, round(sqrt(sum(dx) OVER w * sum(dx) OVER w + sum(dy) OVER w * sum(dy) OVER w), 2) AS base,
 round(sqrt((sum(dx) OVER w - dx) * (sum(dx) OVER w - dx) + (sum(dy) OVER w - dy) * (sum(dy) OVER w - dy)), 2) AS without FROM v WINDOW w AS (PARTITION BY parcel_key)),
r AS (SELECT *, row_number() OVER (PARTITION BY parcel_key ORDER BY without, seq) AS k FROM s WHERE n >= 4 AND base > 0)
SELECT parcel_key, CAST(seq - 1 AS BIGINT) AS call_index, base AS baseline_closure_ft, without AS closure_without_ft FROM r WHERE k = 1 AND (base - without) / base >= 0.5""")
def outlier_call(spark, d):
    o = cogo.outlier_calls(calls(spark, d), ["parcel_key"], ["seq"])
    return o.select("parcel_key", F.col("call_index").cast("long").alias("call_index"), "baseline_closure_ft", "closure_without_ft")


@query("axis_groups", f"""WITH {CALLS}, a AS (SELECT *, (azimuth % 180) AS axis FROM calls), l AS (SELECT *, lag(distance) OVER (PARTITION BY parcel_key, axis ORDER BY seq) AS previous FROM a)
SELECT parcel_key, seq, axis, distance, previous AS previous_distance FROM l WHERE abs(distance - previous) / greatest(distance, previous) > 0.02""")
def axis_groups(spark, d):
    c = cogo.axis_conflicts(calls(spark, d).withColumn("axis", F.pmod("azimuth", F.lit(180.0))), ["parcel_key"], ["seq"])
    return c.select("parcel_key", F.col("seq").cast("long").alias("seq"), "axis", "distance", "previous_distance")


@query("curve_chord", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
 round(((l_partkey * 7) % 360 + (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * (l_quantity + 5) / 2 + 360) % 360, 6) AS azimuth,
 round(2 * (l_extendedprice / 100) * sin(radians((l_quantity + 5) / 2)), 6) AS chord,
 round(((l_partkey * 7) % 360 + (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * (l_quantity + 5) + 360) % 360, 6) AS tangent_out FROM lineitem""")
def curve_chord(spark, d):
    c = G.curve_chord(((F.col("l_partkey") * 7) % 360).cast("double"), F.col("l_quantity") + 5, F.col("l_extendedprice") / 100, F.when(F.col("l_returnflag") == "R", "L"))
    return load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", F.round(c["azimuth"], 6).alias("azimuth"), F.round(c["distance"], 6).alias("chord"), F.round(c["tangent_out"], 6).alias("tangent_out"))


@query("curve_walk", f"""WITH {CALLS}, q AS (SELECT parcel_key, count(*) AS n, sum(distance * sin(radians(azimuth))) AS x, sum(distance * cos(radians(azimuth))) AS y, max(CASE WHEN seq = 1 THEN azimuth END) AS a1, max(CASE WHEN seq = 2 THEN distance END) AS d2 FROM calls GROUP BY 1)
SELECT parcel_key, CAST(n + 1 + CASE WHEN n >= 2 THEN 1 ELSE 0 END AS BIGINT) AS n_points,
 round(x + coalesce(2 * (d2 * 10) * sin(radians(15.0)) * sin(radians((a1 + 15) % 360)), 0), 3) + 0.0 AS x,
 round(y + coalesce(2 * (d2 * 10) * sin(radians(15.0)) * cos(radians((a1 + 15) % 360)), 0), 3) + 0.0 AS y FROM q""")
def curve_walk(spark, d):
    """All lines of each parcel and, after the first, a right-hand 30 degree curve that inherits its tangent."""
    t = text_calls(spark, d)
    radius = F.format_string("%.2f", calls_distance() * 10)
    lines = t.select("parcel_key", (F.col("seq") - 1).alias("seq"), "bearing", "distance")
    curves = t.filter("seq = 2").select("parcel_key", F.lit(0).alias("pos"), F.lit(0).alias("after_call_index"), F.lit("30°00'00\"").alias("delta"), radius.alias("radius"), F.lit(None).cast("string").alias("arc_length"), F.lit(None).cast("string").alias("turn"))
    w = cogo.walk_traverse(cogo.merge_curve_calls(lines, curves, ["parcel_key"]), ["parcel_key"])
    last = F.element_at("points", -1)
    return w.select("parcel_key", F.size("points").cast("long").alias("n_points"), (F.round(last["x"], 3) + 0.0).alias("x"), (F.round(last["y"], 3) + 0.0).alias("y"))


def calls_distance() -> Column:
    return T.distance("distance")


@query("dominant_direction", """SELECT c_nationkey, count(*) AS n, round(degrees(atan2(sum((c_acctbal + 1000) * sin(radians(2 * (c_custkey * 7 % 180)))), sum((c_acctbal + 1000) * cos(radians(2 * (c_custkey * 7 % 180)))))) / 2, 4) AS direction FROM customer GROUP BY 1""")
def dominant_direction(spark, d):
    a = F.radians(2 * (F.col("c_custkey") * 7 % 180))
    w = F.col("c_acctbal") + 1000  # balances start at -999.99, lengths are positive
    return load(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.degrees(F.atan2(F.sum(w * F.sin(a)), F.sum(w * F.cos(a)))) / 2, 4).alias("direction"))


@query("circular_diff", """SELECT o_orderkey, least((o_orderkey * 37 % 360 - o_custkey * 11 % 360 + 360) % 360, 360 - (o_orderkey * 37 % 360 - o_custkey * 11 % 360 + 360) % 360) AS gap,
 ((o_orderkey * 37 % 360 - o_custkey * 11 % 360 + 180 + 720) % 360) - 180 AS turn FROM orders""")
def circular_diff(spark, d):
    a, b = F.col("o_orderkey") * 37 % 360, F.col("o_custkey") * 11 % 360
    return load(spark, d, "orders").select("o_orderkey", G.circular_diff(a, b, 360.0).cast("long").alias("gap"), G.signed_diff(a, b).cast("long").alias("turn"))


@query("shared_edge", f"""WITH {CALLS}, c AS (SELECT *, parcel_key // 300 AS region FROM calls WHERE distance > 0),
p AS (SELECT a.region, a.parcel_key AS parcel_a, b.parcel_key AS parcel_b, a.seq AS seq_a, b.seq AS seq_b, abs(a.distance - b.distance) AS dl,
 least(abs(a.azimuth + 180 - b.azimuth) % 360, 360 - abs(a.azimuth + 180 - b.azimuth) % 360) AS da, abs(a.distance - b.distance) / greatest(a.distance, b.distance) AS rel
 FROM c a JOIN c b ON a.region = b.region AND a.parcel_key < b.parcel_key),
r AS (SELECT *, row_number() OVER (PARTITION BY region, parcel_a, parcel_b ORDER BY dl + da, seq_a, seq_b) AS k FROM p WHERE rel <= 0.02 AND da <= 3)
SELECT region, parcel_a, parcel_b, seq_a, seq_b, round(dl + da, 6) AS score FROM r WHERE k = 1""")
def shared_edge(spark, d):
    e = calls(spark, d).select(F.floor(F.col("parcel_key") / 300).alias("region"), "parcel_key", F.col("seq").cast("long").alias("seq"), "azimuth", F.col("distance").alias("length"))
    s = cogo.shared_edges(e, ["region"], "parcel_key")
    return s.select("region", "parcel_a", "parcel_b", "seq_a", "seq_b", F.round("score", 6).alias("score"))


@query("combined_tract", """WITH s AS (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS total, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_orderkey, n AS stated_n, n >= 2 AND abs(o_totalprice - total) <= 0.15 * total AS combined_tract FROM s""")
def combined_tract(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("stated_area_sqft"), F.col("o_totalprice").alias("area_sqft"))
    return cogo.combined_tract(o, ["o_custkey"]).select("o_orderkey", "stated_n", "combined_tract")


# text


@query("parse_bearing", """WITH b AS (SELECT o_orderkey, (CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE 'S' END) || ' ' || CAST(o_orderkey % 90 AS VARCHAR) || '°' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') || '''' || lpad(CAST(o_orderkey * 7 % 60 AS VARCHAR), 2, '0') || '"' || (CASE WHEN o_custkey % 2 = 0 THEN 'E' ELSE 'W' END) AS bearing,
 (o_orderkey % 90) + (o_custkey % 60) / 60.0 + (o_orderkey * 7 % 60) / 3600.0 AS a FROM orders)
SELECT o_orderkey, round(CASE WHEN bearing LIKE 'N%E' THEN a WHEN bearing LIKE 'S%E' THEN 180 - a WHEN bearing LIKE 'S%W' THEN 180 + a ELSE 360 - a END, 6) AS azimuth,
 round(CASE WHEN bearing LIKE 'N%E' THEN 180 + a WHEN bearing LIKE 'S%E' THEN 360 - a WHEN bearing LIKE 'S%W' THEN a ELSE 180 - a END, 6) AS reversed FROM b""")
def parse_bearing(spark, d):
    o = F.col("o_orderkey")
    text = F.format_string("%s %d°%02d'%02d\"%s", F.when(o % 2 == 0, "N").otherwise("S"), o % 90, F.col("o_custkey") % 60, o * 7 % 60, F.when(F.col("o_custkey") % 2 == 0, "E").otherwise("W"))
    b = load(spark, d, "orders").select("o_orderkey", text.alias("bearing"))
    b = b.withColumn("other", T.reverse_bearing("bearing"))
    return b.select("o_orderkey", F.round(T.azimuth("bearing"), 6).alias("azimuth"), F.round(T.azimuth("other"), 6).alias("reversed"))


@query("parse_area", """SELECT p_partkey, round(CASE WHEN p_partkey % 3 = 0 THEN round(p_retailprice, 2) * 43560 ELSE round(p_retailprice, 2) END, 2) AS area_sqft,
 round(CASE WHEN p_partkey % 3 = 0 THEN round(p_retailprice, 2) ELSE round(p_retailprice, 2) / 43560 END, 8) AS acres FROM part""")
def parse_area(spark, d):
    text = F.concat(F.lit("CONTAINING "), F.format_number("p_retailprice", 2), F.when(F.col("p_partkey") % 3 == 0, " acres more or less").otherwise(" SQ. FT. more or less"))
    p = load(spark, d, "part").select("p_partkey", text.alias("t"))
    return p.select("p_partkey", F.round(T.containing_area_sqft("t"), 2).alias("area_sqft"), F.round(T.acres("t"), 8).alias("acres"))


@query("label_tokens", """SELECT doc_id, CAST(len(regexp_extract_all(upper(replace(coalesce(text, ''), 'ß', 'ss')), '[A-Z0-9]+(?:-[A-Z0-9]+)*')) AS BIGINT) AS tokens,
 len(list_filter(list_distinct(regexp_extract_all(upper(replace(coalesce(text, ''), 'ß', 'ss')), '[A-Z0-9]+(?:-[A-Z0-9]+)*')), lambda x: x IN ('LOT', 'OF', 'THE', 'NO'))) AS generic FROM documents""")
def label_tokens(spark, d):
    t = T.label_tokens("text")
    return load(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("tokens"), F.size(F.filter(F.array_distinct(t), lambda x: x.isin("LOT", "OF", "THE", "NO"))).cast("long").alias("generic"))


APN_TEXT = "'APN ' || lpad(CAST({0} % 7 AS VARCHAR), 3, '0') || '-' || lpad(CAST({0} % 3 * 10 AS VARCHAR), 3, '0') || '-' || lpad(CAST({0} % 2 AS VARCHAR), 2, '0')"


@query("apn_counts", """WITH t AS (SELECT l_orderkey AS document_id, lpad(CAST(l_partkey % 7 AS VARCHAR), 3, '0') || '-' || lpad(CAST(l_partkey % 3 * 10 AS VARCHAR), 3, '0') || '-' || lpad(CAST(l_partkey % 2 AS VARCHAR), 2, '0') AS apn,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem), c AS (SELECT document_id, apn, count(*) AS n, min(pos) AS first FROM t GROUP BY 1, 2)
SELECT document_id, apn, n, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, first) AS rank FROM c""")
def apn_counts(spark, d):
    p = F.col("l_partkey")
    one = F.format_string("A.P.N. %03d-%03d-%02d", p % 7, p % 3 * 10, p % 2)
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", one.alias("t"))
    t = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda s: s["t"]), "; ").alias("text"))
    return evidence.apn_table(t).select("document_id", "apn", "n", F.col("rank").cast("long").alias("rank"))


@query("target_mode", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k, lead(n) OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS nx FROM c)
SELECT user_id, event_type, n FROM r WHERE k = 1 AND (nx IS NULL OR n > nx)""")
def target_mode(spark, d):
    c = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return evidence.strict_mode(c, ["user_id"], "event_type", "n")


OFFICE = r"\b(?:surveyor|surveying|engineer|p\.?l\.?s\.?|inc\.?|llc|planning\s+and\s+building|treasurer|development\s+application)\b"
STREET = r"^\s*\d+[A-Za-z]?(?:\s*,\s*\d+)*\s+(?:[NSEW]\.?\s+)?[0-9A-Za-z_.'' -]+?\s+(?:road|rd|street|st|avenue|ave|boulevard|blvd|drive|dr|lane|ln|way|highway|hwy|court|ct|circle|cir|place|pl|trail)\b"
SCORED = rf"""raw AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '\r\n|\n|\r'))) AS raw, generate_subscripts(regexp_split_to_array(text, '\r\n|\n|\r'), 1) - 1 AS line_no FROM documents),
l AS (SELECT doc_id, line_no, unnest([raw] || CASE WHEN regexp_matches(raw, '[~|]') THEN list_filter(list_transform(regexp_split_to_array(raw, '[~|]'), lambda x: trim(x)), lambda x: length(x) >= 6) ELSE [] END) AS line,
  generate_subscripts([raw] || CASE WHEN regexp_matches(raw, '[~|]') THEN list_filter(list_transform(regexp_split_to_array(raw, '[~|]'), lambda x: trim(x)), lambda x: length(x) >= 6) ELSE [] END, 1) - 1 AS part FROM raw WHERE length(raw) >= 6),
b AS (SELECT *, (CASE WHEN regexp_matches(line, '(?i)\b(?:project|site|property|subject)\s+address\b') THEN 5 ELSE 0 END) + (CASE WHEN regexp_matches(line, '\b\d{{5}}(?:-\d{{4}})?\b') THEN 2 ELSE 0 END) + (CASE WHEN regexp_matches(line, '(?i),\s*[A-Z]{{2}}(?:[^\pL\pN_]|$)|\bCounty\b') THEN 1 ELSE 0 END) AS base,
  regexp_matches(line, '(?i){OFFICE}') OR regexp_matches(line, '\(?\b\d{{3}}\)?[\s.-]*\d{{3}}[\s.-]\d{{4}}\b') AS office FROM l),
s AS (SELECT *, CASE WHEN office THEN base - 3 WHEN base >= 3 AND regexp_matches(line, '(?i){STREET}') THEN base + 1 ELSE base END AS score FROM b)"""


@query("score_lines", f"WITH {SCORED} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(part AS INTEGER) AS part, CAST(score AS INTEGER) AS score FROM s")
def score_lines(spark, d):
    """Scores of all lines and of their parts between ``~`` or ``|``."""
    t = load(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("pos"), "text")
    return evidence.candidate_lines(t).select(F.col("document_id").alias("doc_id"), "line_no", "part", "score")


@query("anchor_candidates")
def anchor_candidates(spark, d):
    """Best address lines and parts of every document and its county."""
    t = load(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("pos"), "text")
    return evidence.anchor_candidates(t).withColumnRenamed("document_id", "doc_id")


@query("coarsen_query", """WITH q AS (SELECT s_suppkey, list_transform(string_split(s_name || ', ' || n_name || ', ' || r_name || ', Earth', ','), lambda x: trim(x)) AS parts FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT s_suppkey, CAST(i AS BIGINT) AS step, array_to_string(list_slice(parts, i + 1, len(parts)), ', ') AS query FROM q, unnest(generate_series(1, len(parts) - 2)) AS u(i)""")
def coarsen_query(spark, d):
    s, n, r = (load(spark, d, t) for t in ("supplier", "nation", "region"))
    j = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])  # 25 and 5 rows
    q = F.concat_ws(", ", "s_name", "n_name", "r_name", F.lit("Earth"))
    return j.select("s_suppkey", F.posexplode(T.coarsen(q)).alias("step", "query")).select("s_suppkey", (F.col("step") + 1).cast("long").alias("step"), "query")


@query("township_parse", """SELECT o_orderkey, CAST(o_orderkey % 40 + 1 AS INTEGER) AS township, CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE 'S' END AS township_dir, CAST(o_custkey % 60 + 1 AS INTEGER) AS "range", CASE WHEN o_custkey % 2 = 0 THEN 'E' ELSE 'W' END AS range_dir,
 CASE WHEN o_orderkey % 3 = 0 THEN 'Mount Diablo Meridian' WHEN o_orderkey % 3 = 1 THEN 'Boise Meridian' ELSE 'Gila and Salt River Meridian' END AS meridian FROM orders""")
def township_parse(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    short = F.format_string("T.%d%s., R. %d%s., ", o % 40 + 1, F.when(o % 2 == 0, "N").otherwise("S"), c % 60 + 1, F.when(c % 2 == 0, "E").otherwise("W"))
    long = F.format_string("Township %d %s, Range %d %s of the Gila and Salt River Base and Meridian", o % 40 + 1, F.when(o % 2 == 0, "North").otherwise("South"), c % 60 + 1, F.when(c % 2 == 0, "East").otherwise("West"))
    t = F.when(o % 3 == 0, F.concat(short, F.lit("M.D.M. rest"))).when(o % 3 == 1, F.concat(short, F.lit("B.M. rest"))).otherwise(long)
    return load(spark, d, "orders").select("o_orderkey", T.township(t).alias("t")).select("o_orderkey", "t.*")


@query("survey_numbers", """SELECT c_custkey, CAST(c_custkey * 1000 + 226 AS DOUBLE) + (c_custkey % 90 + 10) / 100.0 AS value, CASE WHEN c_custkey % 2 = 0 THEN round(1 / (1.0001 + (c_custkey % 100) / 1000000.0), 9) END AS multiplier FROM customer""")
def survey_numbers(spark, d):
    c = F.col("c_custkey")
    raw = F.concat(F.format_number(c * 1000 + 226, 0), F.lit("."), (c % 90 + 10).cast("string"))
    raw = F.when(c % 2 == 0, F.regexp_replace(raw, r",(\d{3})\.", r".$1.")).otherwise(raw)  # a comma misread as a point
    note = F.concat(F.lit("DIVIDE "), F.when(c % 2 == 0, "GROUND COORDINATES").otherwise("GRID VALUES"), F.lit(" BY THE COMBINED FACTOR OF "), F.replace(F.format_string("%.6f", 1.0001 + (c % 100) / 1_000_000.0), F.lit("0"), F.lit("O")))
    return load(spark, d, "customer").select("c_custkey", T.survey_number(raw).alias("value"), F.round(T.ground_to_grid(note), 9).alias("multiplier"))


# joins


@query("region_match", """WITH r AS (SELECT p_brand AS doc, p_partkey, p_retailprice - p_size AS x, 2 * p_size AS w, CAST(p_size AS DOUBLE) AS h FROM part),
l AS (SELECT 'Brand#' || CAST(1 + o_orderkey % 5 AS VARCHAR) || CAST(1 + o_custkey % 5 AS VARCHAR) AS doc, o_orderkey, 900 + o_totalprice % 1200 AS cx, CAST(o_custkey % 20 AS DOUBLE) AS cy FROM orders),
m AS (SELECT l.doc, o_orderkey, p_partkey, row_number() OVER (PARTITION BY l.doc, o_orderkey ORDER BY w * h, p_partkey) AS k FROM l JOIN r ON l.doc = r.doc AND cx BETWEEN x AND x + w AND cy BETWEEN 0 AND h)
SELECT p_partkey, count(*) AS lines FROM m WHERE k = 1 GROUP BY 1""")
def region_match(spark, d):
    p, o = load(spark, d, "part"), load(spark, d, "orders")
    size = F.col("p_size").cast("double")
    regions = p.select(F.col("p_brand").alias("document_id"), F.lit(1).alias("page_number"), F.col("p_partkey").alias("region_index"), F.lit("Text").alias("class"), F.struct((F.col("p_retailprice") - size).alias("x"), F.lit(0.0).alias("y"), (2 * size).alias("w"), size.alias("h")).alias("bbox"))
    cx, cy = 900 + F.col("o_totalprice") % 1200, (F.col("o_custkey") % 20).cast("double")
    doc = F.concat(F.lit("Brand#"), (1 + F.col("o_orderkey") % 5).cast("string"), (1 + F.col("o_custkey") % 5).cast("string"))
    lines = o.select(doc.alias("document_id"), F.lit(1).alias("page_number"), F.col("o_orderkey").alias("line_no"), F.col("o_orderpriority").alias("text"), F.lit(0.9).alias("confidence"), F.struct(cx.alias("x1"), cy.alias("y1"), cx.alias("x2"), cy.alias("y2")).alias("bbox"))
    m = matching.lines_to_regions(lines, regions).filter("ocr_text <> ''")
    return m.select(F.col("region_index").alias("p_partkey"), F.size(F.split("ocr_text", "\n")).cast("long").alias("lines"))


@query("tolerance_join", """WITH p AS (SELECT s_suppkey, s_nationkey, s_acctbal, c_custkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY c_custkey) AS k FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal > 0 AND c_acctbal > 0 AND abs(s_acctbal - c_acctbal) <= 0.05 * s_acctbal)
SELECT s_suppkey, c_custkey FROM p WHERE k = 1""")
def tolerance_join(spark, d):
    s, c = load(spark, d, "supplier"), load(spark, d, "customer")
    return matching.first_within(s.withColumn("nation", F.col("s_nationkey")), c.withColumn("nation", F.col("c_nationkey")), ["nation"], "s_acctbal", "c_acctbal", 0.05, ["s_suppkey"], "c_custkey")


@query("nearest_edge", """WITH n AS (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS k FROM customer JOIN supplier ON c_nationkey = s_nationkey)
SELECT c_custkey, s_suppkey FROM n WHERE k = 1""")
def nearest_edge(spark, d):
    c, s = load(spark, d, "customer"), load(spark, d, "supplier")
    points = c.select(F.col("c_nationkey").alias("nation"), "c_custkey", F.col("c_acctbal").alias("px"), F.lit(0.0).alias("py"))
    edges = s.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("edge_index"), F.col("s_acctbal").alias("ax"), F.lit(0.0).alias("ay"), F.col("s_acctbal").alias("bx"), F.lit(0.0).alias("by"))
    return matching.nearest_edge(points, edges, ["nation"]).select("c_custkey", F.col("edge_index").alias("s_suppkey"))


@query("evidence_semi", "SELECT doc_id, lang FROM documents WHERE EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def evidence_semi(spark, d):
    return load(spark, d, "documents").select("doc_id", "lang").join(load(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("evidence_anti", "SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def evidence_anti(spark, d):
    return progress.orphans(load(spark, d, "documents").select("doc_id", "lang"), load(spark, d, "labels").select("doc_id"), ["doc_id"])


@query("evidence_merge", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(l.quality, -1) AS quality, coalesce(d.lang, 'none') AS lang FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def evidence_merge(spark, d):
    j = load(spark, d, "documents").select("doc_id", "lang").join(load(spark, d, "labels").select("doc_id", "quality"), "doc_id", "full_outer")
    return j.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("lang", F.lit("none")).alias("lang"))


@query("entity_ids", "SELECT o_orderkey, 'p' || CAST(o_custkey AS VARCHAR) || '-x' || CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS VARCHAR) AS id FROM orders")
def entity_ids(spark, d):
    o = load(spark, d, "orders").select(F.lit("doc").alias("document_id"), F.col("o_custkey").alias("page_number"), F.col("o_orderkey").alias("pos"))
    none = spark.createDataFrame([], "document_id string, page_number long, id string")
    return sheets.entity_ids(o, none).select(F.col("pos").alias("o_orderkey"), "id")


@query("printed_id_owner", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey) AS k FROM orders) SELECT o_orderkey, CASE WHEN k = 1 THEN 'ID' || left(o_orderpriority, 1) END AS printed_id FROM r")
def printed_id_owner(spark, d):
    code = F.concat(F.lit("ID"), F.substring("o_orderpriority", 1, 1))
    e = load(spark, d, "orders").select(F.lit("doc").alias("document_id"), F.col("o_custkey").alias("page_number"), F.col("o_orderkey").alias("pos"), code.alias("printed_id"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("PARCEL "), code)).otherwise("PARCEL").alias("label"))
    text = e.select("document_id", "page_number").distinct().withColumn("sheet_text", F.lit("ID1 ID2 ID3 ID4 ID5"))
    return matching.verify_printed_ids(e, text).select(F.col("pos").alias("o_orderkey"), "printed_id")


@query("duplicate_region", "SELECT p_partkey, p_size < 0.2 * max(p_size) OVER (PARTITION BY p_brand, upper(p_type)) AS likely_duplicate_region FROM part")
def duplicate_region(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.col("p_brand").alias("document_id"), F.col("p_type").alias("label"), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("p_size").cast("double").alias("w"), F.lit(1.0).alias("h")).alias("bbox"))
    return matching.flag_duplicate_regions(p).select("p_partkey", "likely_duplicate_region")


@query("radius_topk", """WITH s AS (SELECT s_suppkey, -120 + (s_suppkey * 13 % 400) / 100.0 AS lon, 36 + (s_suppkey * 29 % 400) / 100.0 AS lat FROM supplier), n AS (SELECT n_nationkey, -120 + (n_nationkey * 37 % 400) / 100.0 AS clon, 36 + (n_nationkey * 53 % 400) / 100.0 AS clat FROM nation),
p AS (SELECT n_nationkey, s_suppkey, sqrt(power((clon - lon) * 111320 * cos(radians((clat + lat) / 2)), 2) + power((clat - lat) * 110540, 2)) AS m FROM n, s), r AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY m, s_suppkey) AS k FROM p WHERE m <= 60000)
SELECT n_nationkey, s_suppkey, round(m, 2) AS distance_m, k AS rank FROM r WHERE k <= 40""")
def radius_topk(spark, d):
    at = lambda c, a, b: ((-120 + (F.col(c) * a % 400) / 100.0), (36 + (F.col(c) * b % 400) / 100.0))
    lon, lat = at("s_suppkey", 13, 29)
    clon, clat = at("n_nationkey", 37, 53)
    s = load(spark, d, "supplier").select("s_suppkey", lon.alias("lon"), lat.alias("lat"))
    n = load(spark, d, "nation").select("n_nationkey", clon.alias("clon"), clat.alias("clat"))
    near = matching.near_radius(n, s, "s_suppkey", 60_000.0, 40, cell=0.5)
    return near.select("n_nationkey", "s_suppkey", F.round("distance_m", 2).alias("distance_m"), F.col("rank").cast("long").alias("rank"))


POLYGONS = ((1, ((10.0, 10.0), (60.0, 12.0), (70.0, 55.0), (30.0, 70.0), (5.0, 40.0))), (2, ((0.0, 0.0), (100.0, 0.0), (100.0, 20.0), (40.0, 20.0), (40.0, 90.0), (0.0, 90.0))))


@query("point_in_polygon", """WITH e AS (SELECT event_id, CAST(event_id * 7919 % 10007 AS DOUBLE) / 100 + 0.005 AS x, CAST(event_id * 104729 % 10009 AS DOUBLE) / 100 + 0.005 AS y FROM events), g(polygon_id, ax, ay, bx, cy) AS (VALUES
 (1,10.0,10.0,60.0,12.0),(1,60.0,12.0,70.0,55.0),(1,70.0,55.0,30.0,70.0),(1,30.0,70.0,5.0,40.0),(1,5.0,40.0,10.0,10.0),(2,0.0,0.0,100.0,0.0),(2,100.0,0.0,100.0,20.0),(2,100.0,20.0,40.0,20.0),(2,40.0,20.0,40.0,90.0),(2,40.0,90.0,0.0,90.0),(2,0.0,90.0,0.0,0.0)),
t AS (SELECT *, least(greatest(((x - ax) * (bx - ax) + (y - ay) * (cy - ay)) / ((bx - ax) * (bx - ax) + (cy - ay) * (cy - ay)), 0), 1) AS t FROM e, g),
h AS (SELECT polygon_id, event_id, sum(CASE WHEN (ay > y) <> (cy > y) AND x < (bx - ax) * (y - ay) / (cy - ay) + ax THEN 1 ELSE 0 END) % 2 = 1 OR bool_or(sqrt((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (cy - ay)) ** 2) <= 1e-12) AS covered FROM t GROUP BY 1, 2)
SELECT CAST(polygon_id AS INTEGER) AS polygon_id, CAST(count(*) FILTER (covered) AS BIGINT) AS n FROM h GROUP BY 1""")
def point_in_polygon(spark, d):
    """Events as points inside or on two outlines; of some that lie on a slanting edge rounding decides whether a ray crosses it, so SQL says "on" by distance, too."""
    polygons = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in p]) for i, p in POLYGONS], "polygon_id int, ring array<struct<x:double,y:double>>")
    e = F.col("event_id")
    points = load(spark, d, "events").select(((e * 7919 % 10007).cast("double") / 100 + 0.005).alias("x"), ((e * 104729 % 10009).cast("double") / 100 + 0.005).alias("y"))
    return matching.features_in_polygons(polygons, points, cell=10.0)


@query("greedy_match")
def greedy_match(spark, d):
    s, c = load(spark, d, "supplier"), load(spark, d, "customer")
    e = s.select(F.lit("doc").alias("document_id"), F.col("s_nationkey").alias("page_number"), F.col("s_suppkey").alias("pos"), F.concat(F.lit("PARCEL "), F.col("s_suppkey") % 7).alias("label"), F.lit(None).cast("string").alias("printed_id"), F.format_string("%.2f AC", F.abs("s_acctbal")).alias("stated_area"))
    k = c.select(F.lit("doc").alias("document_id"), F.col("c_nationkey").alias("page_number"), F.col("c_custkey").alias("pos"), F.concat(F.lit("PARCEL "), F.col("c_custkey") % 7).alias("label"), F.abs("c_acctbal").alias("acres"))
    return matching.match_evidence(e, k)


@query("nms")
def nms(spark, d):
    p = load(spark, d, "part").select("p_brand", F.col("p_partkey").alias("pos"), F.col("p_type").alias("class"), (F.col("p_retailprice") % 100).alias("x"), (F.col("p_partkey") % 10).cast("double").alias("y"), F.col("p_size").cast("double").alias("w"), F.lit(10.0).alias("h"), (F.col("p_partkey") % 97 / 97.0).alias("confidence"))
    return matching.nms(p, ["p_brand"])


# sheets, sets, statuses


@query("sheet_build", """WITH r AS (SELECT *, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS top, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, i) AS k FROM r)
SELECT l_orderkey, CAST(max(CASE WHEN k = 1 THEN i END) AS BIGINT) AS main_region, CAST(sum(CASE WHEN l_extendedprice >= 0.2 * top THEN 1 ELSE 0 END) AS BIGINT) AS drawings, CAST(sum(CASE WHEN l_extendedprice >= 0.2 * top THEN 0 ELSE 1 END) AS BIGINT) AS insets FROM k GROUP BY 1""")
def sheet_build(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    r = load(spark, d, "lineitem").select(F.lit("doc").alias("document_id"), F.col("l_orderkey").alias("page_number"), (F.row_number().over(w) - 1).alias("region_index"), F.lit("ParcelMap").alias("class"), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("l_extendedprice").alias("w"), F.lit(1.0).alias("h")).alias("bbox"))
    return sheets.build_sheets(r).select(F.col("page_number").alias("l_orderkey"), F.col("main_region").cast("long").alias("main_region"), F.size("regions").cast("long").alias("drawings"), F.size("inset_regions").cast("long").alias("insets"))


@query("sheet_division", """WITH m AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS i FROM lineitem), n AS (SELECT g, count(*) AS n FROM m GROUP BY 1)
SELECT a.g AS inner_group, b.g AS outer_group FROM m a JOIN m b ON a.i = b.i AND a.g <> b.g JOIN n ON n.g = a.g GROUP BY 1, 2 HAVING count(*) = max(n)""")
def sheet_division(spark, d):
    """Containment between the supplier sets of all orders."""
    return sheets.contained_sets(load(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey", "l_suppkey")


@query("chunk_budget", """WITH RECURSIVE i AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
c AS (SELECT o_custkey, o_orderkey, r, tokens AS used, 0 AS chunk FROM i WHERE r = 1 UNION ALL SELECT i.o_custkey, i.o_orderkey, i.r, CASE WHEN c.used > 0 AND c.used + i.tokens > 500000 THEN i.tokens ELSE c.used + i.tokens END, CASE WHEN c.used > 0 AND c.used + i.tokens > 500000 THEN c.chunk + 1 ELSE c.chunk END FROM c JOIN i ON i.o_custkey = c.o_custkey AND i.r = c.r + 1)
SELECT o_orderkey, CAST(chunk AS INTEGER) AS chunk FROM c""")
def chunk_budget(spark, d):
    o = load(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("pos"), F.floor("o_totalprice").alias("tokens"))
    return sheets.chunk_by_budget(o, ["o_custkey"], 500_000).select(F.col("pos").alias("o_orderkey"), "chunk")


FLAGS = """SELECT o_orderkey, o_orderkey % 11 = 0 AS manual_position, o_orderkey % 13 = 0 AS anchor_override, o_orderkey % 5 <> 0 AS human_confirmed, o_orderkey % 17 = 0 AS awaiting_bind, o_custkey % 7 = 0 AS control_reading,
 CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'unverified' WHEN 2 THEN 'single_source' END AS calibration_status, CASE o_custkey % 3 WHEN 0 THEN 'surveyed_corner' WHEN 1 THEN 'approximate' END AS placement_status,
 CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS shape_valid, o_custkey % 19 = 0 AS aliquot_corroborated, o_custkey % 23 = 0 AS apn_corroborated, o_custkey % 29 = 0 AS control_validated, o_custkey % 2 = 0 AS apn_fit, 'city' AS anchor_precision FROM orders"""


@query("verdict", f"""WITH f AS ({FLAGS}), g AS (SELECT *, anchor_override OR manual_position OR coalesce(placement_status = 'surveyed_corner', false) OR aliquot_corroborated OR apn_corroborated AS placed,
 CASE WHEN NOT human_confirmed THEN 'not_applicable' WHEN calibration_status = 'pending' THEN 'pending' WHEN calibration_status = 'single_source' OR aliquot_corroborated OR control_validated OR apn_corroborated THEN 'placeable' ELSE 'unconfirmed' END AS gate FROM f)
SELECT o_orderkey, CASE WHEN awaiting_bind THEN 'Confirming boundary…' WHEN NOT human_confirmed THEN 'Boundary not confirmed' WHEN control_reading AND NOT coalesce(placement_status = 'surveyed_corner', false) AND NOT apn_corroborated THEN 'Refining placement…' WHEN gate = 'pending' THEN 'Calibrating & placing…'
 WHEN shape_valid IS NULL THEN 'Outline saved · not placed on the map' WHEN manual_position OR anchor_override THEN CASE WHEN shape_valid THEN 'Placed by hand' ELSE 'Placed by hand · check area' END WHEN gate = 'unconfirmed' THEN CASE WHEN calibration_status = 'unverified' THEN 'Unconfirmed placement' ELSE 'Unconfirmed placement · no anchor' END
 WHEN shape_valid AND placed THEN 'Verified' WHEN shape_valid THEN 'Shape OK · location approx.' ELSE 'Needs review' END AS verdict,
 CASE WHEN anchor_override OR manual_position THEN 'manual' WHEN control_validated THEN 'control' WHEN apn_corroborated THEN 'apn' WHEN aliquot_corroborated THEN 'aliquot' WHEN placement_status = 'surveyed_corner' THEN 'surveyed_corner' WHEN apn_fit THEN 'apn_approx' ELSE 'anchor' END AS method FROM g""")
def verdict(spark, d):
    f = load(spark, d, "orders").selectExpr(
        "o_orderkey", "o_orderkey % 11 = 0 AS manual_position", "o_orderkey % 13 = 0 AS anchor_override", "o_orderkey % 5 <> 0 AS human_confirmed", "o_orderkey % 17 = 0 AS awaiting_bind", "o_custkey % 7 = 0 AS control_reading",
        "CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'unverified' WHEN 2 THEN 'single_source' END AS calibration_status", "CASE o_custkey % 3 WHEN 0 THEN 'surveyed_corner' WHEN 1 THEN 'approximate' END AS placement_status",
        "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS shape_valid", "o_custkey % 19 = 0 AS aliquot_corroborated", "o_custkey % 23 = 0 AS apn_corroborated", "o_custkey % 29 = 0 AS control_validated", "o_custkey % 2 = 0 AS apn_fit", "'city' AS anchor_precision",
    )
    p = F.struct(*f.columns)
    return f.select("o_orderkey", status.verdict(p).alias("verdict"), status.placement_method(p)["method"].alias("method"))


@query("calibration_status", """SELECT o_orderkey, CASE WHEN o_totalprice % 10 > 5 OR o_orderkey % 7 = 0 THEN 'unverified' WHEN o_custkey % 4 >= 2 THEN 'cross_validated' WHEN least(o_orderkey % 360, 360 - o_orderkey % 360) > 10 THEN 'unverified' ELSE 'single_source' END AS status FROM orders""")
def calibration_status(spark, d):
    o = F.col("o_orderkey")
    s = placement.calibration_status(F.when(o % 7 != 0, (o % 360).cast("double")), F.col("o_totalprice") % 10, F.col("o_custkey") % 4)
    return load(spark, d, "orders").select("o_orderkey", s.alias("status"))


@query("median_cluster", """WITH s AS (SELECT s_nationkey, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) - 1 AS r, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier), m AS (SELECT s_nationkey, max(CASE WHEN r = n // 2 THEN s_acctbal END) AS mid FROM s GROUP BY 1)
SELECT s.s_nationkey, mid, count(*) AS n, count(*) FILTER (abs(s_acctbal - mid) <= 2000) AS within FROM s JOIN m USING (s_nationkey) GROUP BY 1, 2""")
def median_cluster(spark, d):
    s = load(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list("s_acctbal").alias("v"))
    s = s.withColumn("mid", placement.upper_median(F.col("v")))
    return s.select("s_nationkey", "mid", F.size("v").cast("long").alias("n"), F.size(F.filter("v", lambda x: F.abs(x - F.col("mid")) <= 2000)).cast("long").alias("within"))


@query("sheet_scale", """WITH s AS (SELECT p_brand, sqrt(p_retailprice / (p_size * 10 + 900)) AS s FROM part), o AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY s) - 1 AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM s)
SELECT p_brand, n, round(CASE WHEN n >= 2 AND (max(s) - min(s)) / max(CASE WHEN r = n // 2 THEN s END) <= 0.02 THEN max(CASE WHEN r = n // 2 THEN s END) END, 6) AS sheet_scale FROM o GROUP BY 1, 2""")
def sheet_scale(spark, d):
    p = load(spark, d, "part").select("p_brand", F.col("p_retailprice").alias("stated_area_sqft"), (F.col("p_size") * 10 + 900).alias("pixel_area"))
    return placement.sheet_scale(p, ["p_brand"]).select("p_brand", F.col("n").cast("long").alias("n"), F.round("sheet_scale", 6).alias("sheet_scale"))


@query("scale_median", "SELECT l_suppkey, round(median(l_extendedprice / l_quantity), 6) AS scale, round(max(abs(l_discount - 0.05)), 6) AS spread FROM lineitem GROUP BY 1")
def scale_median(spark, d):
    return load(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.median(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("scale"), F.round(F.max(F.abs(F.col("l_discount") - 0.05)), 6).alias("spread"))


# screens and planes


@query("haversine_pairs", """WITH n AS (SELECT n_nationkey, (n_nationkey * 37 % 360) - 180.0 AS lon, (n_nationkey * 53 % 160) - 80.0 AS lat FROM nation)
SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(2 * 6371 * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))), 4) AS km FROM n a JOIN n b ON a.n_nationkey < b.n_nationkey""")
def haversine_pairs(spark, d):
    """All pairs of the nations, a fixed table of 25 rows."""
    k = F.col("n_nationkey")
    n = load(spark, d, "nation").select(k.alias("k"), (k * 37 % 360 - 180.0).alias("lon"), (k * 53 % 160 - 80.0).alias("lat"))
    pairs = n.alias("a").join(F.broadcast(n.alias("b")), F.col("a.k") < F.col("b.k"))
    return pairs.select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.round(G.haversine(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat")), 4).alias("km"))


@query("mercator_px", """WITH e AS (SELECT event_id, (event_id * 7919 % 36000) / 100.0 - 180 AS lon, (event_id * 104729 % 16000) / 100.0 - 80 AS lat, event_id % 15 + 2 AS z FROM events)
SELECT event_id, round((lon + 180) / 360 * 256 * power(2, z), 3) AS x, round((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 256 * power(2, z), 3) AS y, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6) + 1 AS INTEGER) AS epsg FROM e""")
def mercator_px(spark, d):
    k = F.col("event_id")
    lon, lat = (k * 7919 % 36000) / 100.0 - 180, (k * 104729 % 16000) / 100.0 - 80
    p = G.mercator_px(lon, lat, k % 15 + 2)
    return load(spark, d, "events").select("event_id", F.round(p["x"], 3).alias("x"), F.round(p["y"], 3).alias("y"), G.utm_epsg(lon, lat).cast("int").alias("epsg"))


@query("box_iou", """WITH b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity AS x, 10.0 AS w, 20.0 AS bx, CAST(l_linenumber AS DOUBLE) AS y, 5.0 AS h FROM lineitem), i AS (SELECT *, greatest(least(x + w, bx + 12) - greatest(x, bx), 0) * greatest(least(y + h, 8) - greatest(y, 2), 0) AS n FROM b)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, round(n / (w * h + 72 - n), 6) AS iou FROM i""")
def box_iou(spark, d):
    box = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    iou = G.box_iou(box(F.col("l_quantity"), F.col("l_linenumber").cast("double"), 10.0, 5.0), box(F.lit(20.0), F.lit(2.0), 12.0, 6.0))
    return load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", F.round(iou, 6).alias("iou"))


@query("tm_project")
def tm_project(spark, d):
    k = F.col("c_custkey")
    c = load(spark, d, "customer").select("c_custkey", F.lit(3423).alias("epsg"), (-119.9 + (k % 200) / 100.0).alias("lon"), (38.0 + (k % 300) / 100.0).alias("lat"))
    c = c.withColumn("g", E.lonlat_to_grid("epsg", "lon", "lat")).withColumn("back", E.grid_to_lonlat("epsg", F.col("g.x"), F.col("g.y")))
    return c.select("c_custkey", F.round("g.x", 3).alias("easting"), F.round("g.y", 3).alias("northing"), F.round(F.abs(F.col("back.lon") - F.col("lon")) + F.abs(F.col("back.lat") - F.col("lat")), 9).alias("error"))


@query("bearing_between")
def bearing_between(spark, d):
    k = F.col("c_custkey")
    b = outline.bearing_between(F.lit(-119.8), F.lit(39.5), -119.8 + (k % 100 - 50) / 1000.0, 39.5 + (k % 70 - 35) / 1000.0)
    return load(spark, d, "customer").select("c_custkey", b.alias("b")).select("c_custkey", "b.bearing", "b.distance_ft")


# repairs


@query("assemble_traverse")
def assemble_traverse(spark, d):
    t = text_calls(spark, d).groupBy("parcel_key").agg(F.sort_array(F.collect_list(F.struct("seq", "bearing", "distance"))).alias("c"))
    p = t.select("parcel_key", F.transform("c", lambda x: F.struct(x["bearing"].alias("bearing"), x["distance"].alias("distance"))).alias("calls"), F.array().cast("array<struct<bearing:string,distance:string>>").alias("alternates"), F.lit(None).cast("double").alias("stated_area_sqft"), F.array().cast("array<double>").alias("sibling_sqfts"))
    r = search.repair_frame(p, ["parcel_key"])
    return r.select("parcel_key", F.size("calls").alias("n_calls"), F.size("notes").alias("n_notes"))


# reports, edits, events


@query("attribute_row", "SELECT p_partkey, substr(coalesce(p_name, ''), 1, 254) AS label, substr(coalesce(p_type, ''), 1, 10) AS type, round(p_retailprice / 43560, 3) AS acres, 'approximate' AS location FROM part")
def attribute_row(spark, d):
    return load(spark, d, "part").select("p_partkey", report.text_field(F.col("p_name")).alias("label"), report.text_field(F.col("p_type"), 10).alias("type"), F.round(F.col("p_retailprice") / T.SQFT_PER_ACRE, 3).alias("acres"), F.lit("approximate").alias("location"))


@query("vertices_explode", "SELECT vec_id, CAST(i AS INTEGER) AS vertex, CAST(embedding[i] AS DOUBLE) AS lon FROM embeddings, unnest(generate_series(1, len(embedding))) AS u(i)")
def vertices_explode(spark, d):
    e = load(spark, d, "embeddings").select(F.lit("doc").alias("document_id"), F.col("vec_id").alias("id"), F.transform("embedding", lambda v: F.struct(v.cast("double").alias("x"), F.lit(0.0).alias("y"))).alias("ring"))
    return report.vertex_rows(e).select(F.col("id").alias("vec_id"), "vertex", "lon")


EDITS = "SELECT 'doc' AS document_id, 'parcel' AS scope, o_custkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'label' WHEN 1 THEN 'review_status' ELSE 'area' END AS field, CASE o_orderkey % 3 WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'approved' ELSE 'maybe' END ELSE o_orderpriority END AS value, 'me' AS editor, o_orderkey AS edited FROM orders"


@query("edits_overlay", f"""WITH e AS ({EDITS}), v AS (SELECT * FROM e WHERE field = 'label' OR (field = 'review_status' AND value = 'approved')), l AS (SELECT id, arg_max(value, edited) FILTER (field = 'label') AS label, arg_max(value, edited) FILTER (field = 'review_status') AS review FROM v GROUP BY 1)
SELECT c_custkey, coalesce(label, c_name) AS label, coalesce(review, 'pending') AS review_status FROM customer LEFT JOIN l ON l.id = c_custkey""")
def edits_overlay(spark, d):
    e = spark.sql(EDITS.replace("FROM orders", "FROM {orders}"), orders=load(spark, d, "orders")).withColumnRenamed("edited", "at")
    r = load(spark, d, "customer").select(F.lit("doc").alias("document_id"), F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit("pending").alias("review_status"))
    return report.overlay(r, e).select(F.col("id").alias("c_custkey"), "label", "review_status")


@query("edit_log", f"""WITH e AS ({EDITS}), v AS (SELECT *, lag(value) OVER (PARTITION BY id, field ORDER BY edited) AS old, row_number() OVER (PARTITION BY id, field ORDER BY edited) AS r FROM e WHERE field = 'label' OR (field = 'review_status' AND value = 'approved'))
SELECT id, field, value, edited FROM v WHERE r = 1 OR value <> old""")
def edit_log(spark, d):
    return report.edit_log(spark.sql(EDITS.replace("FROM orders", "FROM {orders}"), orders=load(spark, d, "orders")).withColumnRenamed("edited", "at")).select("id", "field", "value", F.col("at").alias("edited"))


@query("latest_confirmation", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def latest_confirmation(spark, d):
    return report.latest(load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("manual_positions", """WITH last AS (SELECT user_id, max(event_id) AS c FROM events GROUP BY 1), m AS (SELECT user_id, event_id, value FROM events WHERE event_type <> 'click'), r AS (SELECT user_id, max(event_id) AS reset FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT m.user_id AS parcel_key, count(*) AS moves, round(sum(value), 3) AS east_m FROM m LEFT JOIN r USING (user_id) WHERE reset IS NULL OR event_id > reset GROUP BY 1""")
def manual_positions(spark, d):
    e = load(spark, d, "events")
    moves = e.filter("event_type <> 'click'").select(F.col("user_id").alias("parcel_key"), F.lit("c1").alias("confirmation_id"), F.col("event_id").alias("ts"), F.col("value").alias("east_m"), F.lit(0.0).alias("north_m"))
    resets = e.filter("event_type = 'click'").select(F.col("user_id").alias("parcel_key"), F.col("event_id").alias("ts"))
    current = moves.select("parcel_key", "confirmation_id").distinct()
    return placement.manual_positions(moves, resets, current).select("parcel_key", "moves", "east_m")


@query("rate_limit_window", """SELECT event_id, count(*) OVER w AS in_window, count(*) OVER w <= 12 AS allowed FROM events WINDOW w AS (PARTITION BY event_type ORDER BY epoch(ts) RANGE BETWEEN 600 PRECEDING AND CURRENT ROW)""")
def rate_limit_window(spark, d):
    return progress.rate_window(load(spark, d, "events"), ["event_type"], "ts", 600, 12).select("event_id", "in_window", "allowed")


@query("session_gap", """WITH g AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w > 21600 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events FROM s GROUP BY 1, 2""")
def session_gap(spark, d):
    return progress.sessions(load(spark, d, "events"), ["user_id"], "ts", 21_600).select("user_id", F.col("session").cast("long").alias("session"), "events")


@query("tumbling", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling(spark, d):
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@query("last_stage", "SELECT user_id, arg_max(event_type, (ts, event_type)) AS stage, count(*) AS updates FROM events GROUP BY 1")
def last_stage(spark, d):
    e = load(spark, d, "events").select(F.col("user_id").alias("document_id"), "ts", F.col("event_type").alias("stage"), F.lit(None).cast("string").alias("detail"), F.lit(None).cast("string").alias("error"))
    return progress.current_progress(e).select(F.col("document_id").alias("user_id"), "stage", F.size("history").cast("long").alias("updates"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return load(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("summarize_runs", """SELECT c_mktsegment, count(*) AS parcels, count(*) FILTER (c_acctbal > 0) AS valid, round(avg(c_acctbal), 4) AS mean_balance, CAST(grouping(c_mktsegment) AS INTEGER) AS is_total FROM customer GROUP BY ROLLUP (c_mktsegment)""")
def summarize_runs(spark, d):
    return report.pooled(load(spark, d, "customer"), "c_mktsegment", {"parcels": F.count(F.lit(1)), "valid": F.count_if(F.col("c_acctbal") > 0), "mean_balance": F.round(F.avg("c_acctbal"), 4)})


@query("rates_null_div", "SELECT user_id, count(*) AS n, round(CASE WHEN count(*) FILTER (event_type = 'view') > 0 THEN CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) / count(*) FILTER (event_type = 'view') END, 6) AS rate FROM events GROUP BY 1")
def rates_null_div(spark, d):
    n = lambda t: F.count_if(F.col("event_type") == t).cast("double")
    return load(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.try_divide(n("click"), n("view")), 6).alias("rate"))


@query("issue_buckets", "SELECT CASE o_orderstatus WHEN 'F' THEN 'weak_closure' WHEN 'O' THEN 'area_mismatch' ELSE 'other' END AS bucket, count(*) AS n FROM orders GROUP BY 1")
def issue_buckets(spark, d):
    text = F.when(F.col("o_orderstatus") == "F", "Weak closure: precision ratio").when(F.col("o_orderstatus") == "O", "Walked area differs").otherwise("Something else")
    return load(spark, d, "orders").groupBy(status.issue_bucket(text).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


from . import documents, parcels, planted  # noqa: E402, F401  they register their own
