"""Registered queries of exact overlay, placements among county parcels, zones, large areas and background reads, with closed forms in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geodesy as E
from ..functions import geometry as G
from ..functions import zones as Z
from ..operators import moves, overlay, placement
from ..sources.session import spread
from ..streaming import jobs
from .planted import _xy
from .queries import load, query

LAT, LON = 39.6, -119.8


def _corner(x, y) -> Column:
    """Metres east and north of the site as lon/lat."""
    x, y = (v if isinstance(v, Column) else F.lit(float(v)) for v in (x, y))
    return _xy(LON + x / (G.M_PER_DEG_LON * F.cos(F.radians(F.lit(LAT)))), LAT + y / G.M_PER_DEG_LAT)


def _box(x, y, w, h) -> Column:
    return F.array(_corner(x, y), _corner(x + w, y), _corner(x + w, y + h), _corner(x, y + h))


@query("polygon_overlay", """WITH r AS (SELECT DISTINCT l_orderkey AS k, l_returnflag = 'A' AS a, l_partkey % 50 AS x, l_suppkey % 40 AS y, CAST(l_quantity AS BIGINT) AS w, l_linenumber * 3 AS h FROM lineitem),
 xs AS (SELECT k, x, lead(x) OVER (PARTITION BY k ORDER BY x) - x AS dx FROM (SELECT k, x FROM r UNION SELECT k, x + w FROM r)),
 ys AS (SELECT k, y, lead(y) OVER (PARTITION BY k ORDER BY y) - y AS dy FROM (SELECT k, y FROM r UNION SELECT k, y + h FROM r)),
 c AS (SELECT xs.k, xs.x, ys.y, dx * dy AS size, bool_or(r.a) AS a, bool_or(NOT r.a) AS b FROM xs JOIN ys ON xs.k = ys.k JOIN r ON r.k = xs.k AND r.x <= xs.x AND r.x + r.w >= xs.x + dx AND r.y <= ys.y AND r.y + r.h >= ys.y + dy GROUP BY ALL)
SELECT k AS l_orderkey, CAST(coalesce(sum(size) FILTER (a), 0) AS BIGINT) AS area_a, CAST(coalesce(sum(size) FILTER (b), 0) AS BIGINT) AS area_b, CAST(sum(size) AS BIGINT) AS area_union, CAST(coalesce(sum(size) FILTER (a AND b), 0) AS BIGINT) AS area_shared FROM c GROUP BY 1""")
def polygon_overlay(spark, d):
    """Order lines as tilted rectangles: what returned and other lines of an order cover, alone and together.

    The rectangles are turned by the angle of a 3-4-5 triangle, which changes no area; SQL counts the cells of the upright ones.
    """
    c = lambda dx, dy: _xy(0.6 * (F.col("x") + dx) - 0.8 * (F.col("y") + dy), 0.8 * (F.col("x") + dx) + 0.6 * (F.col("y") + dy))
    r = load(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "A", "a").otherwise("b").alias("side"), (F.col("l_partkey") % 50).alias("x"), (F.col("l_suppkey") % 40).alias("y"), F.col("l_quantity").alias("w"), (F.col("l_linenumber") * 3).alias("h"))
    none = F.lit(0)
    rings = r.select("l_orderkey", "side", F.xxhash64("x", "y", "w", "h").alias("part"), F.array(c(none, none), c(F.col("w"), none), c(F.col("w"), F.col("h")), c(none, F.col("h"))).alias("ring"))
    areas = overlay.overlay_areas(rings, ["l_orderkey"])
    return areas.select("l_orderkey", *(F.round(c).cast("long").alias(c) for c in overlay.AREAS))


_SIDE = 40.6
_OFFSET = "((c_custkey % 11 - 5) * 1.3717)", "((c_custkey % 7 - 3) * 2.1133)"


@query("evaluate_position", f"""WITH c AS (SELECT c_custkey, {_OFFSET[0]} AS e, {_OFFSET[1]} AS n, c_custkey % 4 AS turn FROM customer),
 nb AS (SELECT * FROM (VALUES (40.0, 0.0), (-40.0, 0.0), (0.0, 40.0), (0.0, -40.0)) AS v(cx, cy)),
 i AS (SELECT k, k * 4 * {_SIDE} / 81 AS s FROM range(81) t(k)),
 p AS (SELECT k, CASE CAST(floor(s / {_SIDE}) AS INT) WHEN 0 THEN s - {_SIDE} / 2 WHEN 1 THEN {_SIDE} / 2 WHEN 2 THEN 2.5 * {_SIDE} - s ELSE -{_SIDE} / 2 END AS x, CASE CAST(floor(s / {_SIDE}) AS INT) WHEN 0 THEN -{_SIDE} / 2 WHEN 1 THEN s - 1.5 * {_SIDE} WHEN 2 THEN {_SIDE} / 2 ELSE 3.5 * {_SIDE} - s END AS y FROM i),
 q AS (SELECT c_custkey, e + CASE turn WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN -x ELSE -y END AS x, n + CASE turn WHEN 0 THEN y WHEN 1 THEN -x WHEN 2 THEN -y ELSE x END AS y, k FROM c, p),
 g AS (SELECT c_custkey, k, min(CASE WHEN greatest(abs(x - cx), abs(y - cy)) <= 20 THEN 20 - greatest(abs(x - cx), abs(y - cy)) ELSE sqrt(greatest(abs(x - cx) - 20, 0) ** 2 + greatest(abs(y - cy) - 20, 0) ** 2) END) AS gap FROM q, nb GROUP BY ALL),
 o AS (SELECT c_custkey, sum(greatest(0, least(e + {_SIDE} / 2, cx + 20) - greatest(e - {_SIDE} / 2, cx - 20)) * greatest(0, least(n + {_SIDE} / 2, cy + 20) - greatest(n - {_SIDE} / 2, cy - 20))) AS shared FROM c, nb GROUP BY 1)
SELECT c_custkey, round(shared / {_SIDE} / {_SIDE} * 100, 1) AS overlap_pct, round(count(*) FILTER (gap <= 3) * 100.0 / 81, 1) AS hugging_pct, round(avg(least(gap, 10)), 2) AS mean_gap_m, round(min(gap), 1) AS nearest_edge_m, 4 AS neighbour_count FROM g JOIN o USING (c_custkey) GROUP BY c_custkey, shared""")
def evaluate_position(spark, d):
    """Every customer a lot that is a little too large for the gap between four others: how it would sit after a move and a turn."""
    east, north = (F.expr(x) for x in _OFFSET)
    half = F.lit(_SIDE / 2)
    lot = F.array(_box(-half, -half, F.lit(_SIDE), F.lit(_SIDE)))
    around = F.array(*(_box(F.lit(x - 20.0), F.lit(y - 20.0), F.lit(40.0), F.lit(40.0)) for x, y in ((40, 0), (-40, 0), (0, 40), (0, -40))))
    c = load(spark, d, "customer").select("c_custkey", lot.alias("rings"), around.alias("neighbours"), east.cast("double").alias("east_m"), north.cast("double").alias("north_m"), (F.col("c_custkey") % 4 * 90.0).alias("rotation_deg"))
    return moves.evaluate_positions(c, ["c_custkey"])


@query("apn_fit_cases", """SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 3 THEN 'target_parcel' ELSE 'between_neighbours' END AS mode, n_nationkey % 5 <> 4 AS corroborated,
 CASE WHEN n_nationkey % 5 < 4 THEN CAST(20 - n_nationkey % 3 * 15 AS BIGINT) END AS east_m, CASE WHEN n_nationkey % 5 < 4 THEN CAST(25 - n_nationkey % 4 * 10 AS BIGINT) END AS north_m, CASE WHEN n_nationkey % 5 < 4 THEN CASE WHEN n_nationkey % 5 = 2 THEN 90.0 ELSE 0.0 END END AS turned, CASE WHEN n_nationkey % 5 < 3 THEN 0.0 WHEN n_nationkey % 5 = 3 THEN 1.0 END AS overlap FROM nation""")
def apn_fit_cases(spark, d):
    """Every nation a sheet of three lots: moved out of their gap, turned as well, with the county's own parcel, or along an even row.

    Along the row (every fifth) neighbours don't pin the lots down: no fit may be corroborated there.
    """
    k = F.col("n_nationkey")
    kind, dx, dy = k % 5, (k % 3 * 15 - 20).cast("double"), (k % 4 * 10 - 25).cast("double")
    lots = [_box(30.0 * i + dx, dy, F.lit(30.0), F.lit(50.0)) for i in range(3)]
    # a quarter turn about the middle of the gap, (45, 25)
    upright = [_box(20.0 + dx, 30.0 * i - 20.0 + dy, F.lit(50.0), F.lit(30.0)) for i in range(3)]
    gap = ((-60, 0, 60, 50), (90, 0, 60, 50), (-60, 50, 105, 40), (45, 50, 105, 40), (-60, -40, 105, 40), (45, -40, 105, 40))
    row = [(30 * i, 60, 30, 50) for i in range(-16, 18)]
    boxes = lambda all_: F.array(*(_box(*map(F.lit, map(float, b))) for b in all_))
    own = _box(*map(F.lit, (0.0, 0.0, 90.0, 50.0)))
    s = load(spark, d, "nation").select("n_nationkey", kind.alias("kind"), F.when(kind == 2, F.array(*upright)).otherwise(F.array(*lots)).alias("rings"), F.when(kind == 4, boxes(row)).otherwise(boxes(gap)).alias("neighbours"), F.when(kind == 3, own).alias("target")).repartition("n_nationkey")
    f = placement.apn_fits(s, ["n_nationkey", "kind"])
    pinned = lambda c: F.when(F.col("kind") < 4, c)
    return f.select("n_nationkey", "mode", "corroborated", pinned(F.round("east_m").cast("long")).alias("east_m"), pinned(F.round("north_m").cast("long")).alias("north_m"), pinned(F.abs(F.round("rotation_deg", 1))).alias("turned"), pinned(F.round("overlap", 2)).alias("overlap"))


_KIND = "CASE WHEN event_id % 5 < 3 THEN 'request' WHEN event_id % 5 = 3 THEN 'result' ELSE 'failure' END"
_HOURS = 3600


@query("job_attempts", f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS tm, CASE WHEN event_id % 5 < 3 THEN 3 WHEN event_id % 5 = 3 THEN 1 ELSE 2 END AS rank, CASE WHEN event_id % 5 < 3 THEN 0 ELSE event_id % 3 + 1 END AS attempt FROM events),
 o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tm, rank, attempt) AS k, max(tm) OVER () AS last FROM e),
 s AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS a, CAST(NULL AS BIGINT) AS started, false AS running, CAST(NULL AS BIGINT) AS done, CAST(NULL AS BIGINT) AS stale_a, CAST(NULL AS BIGINT) AS stale_at, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS out_a, CAST(NULL AS BIGINT) AS out_started, CAST(NULL AS BIGINT) AS ended FROM (SELECT DISTINCT user_id FROM o)
  UNION ALL SELECT user_id, k,
   CASE WHEN rank = 3 AND NOT running2 AND done2 IS NULL THEN a2 + 1 ELSE a2 END, CASE WHEN rank = 3 AND NOT running2 AND done2 IS NULL THEN tm ELSE started END,
   CASE WHEN rank = 3 AND done2 IS NULL THEN true WHEN rank < 3 AND mine THEN false ELSE running2 END, CASE WHEN rank = 1 AND mine AND done2 IS NULL THEN tm ELSE done2 END,
   CASE WHEN running AND NOT running2 THEN a END, CASE WHEN running AND NOT running2 THEN started + {2 * _HOURS * 1000000} END,
   CASE WHEN rank = 1 AND mine AND running2 THEN 'done' WHEN rank = 1 AND mine AND done2 IS NULL THEN 'done late' WHEN rank = 1 THEN 'ignored' WHEN rank = 2 AND mine AND running2 THEN 'failed' END,
   attempt, CASE WHEN mine AND (running2 OR done2 IS NULL) THEN started END, tm
  FROM (SELECT o.user_id, o.k, o.tm, o.rank, o.attempt, s.a, s.started, s.running, s.running AND o.tm < s.started + {2 * _HOURS * 1000000} AS running2,
    CASE WHEN o.tm >= s.done + {24 * _HOURS * 1000000} THEN NULL ELSE s.done END AS done2, CASE WHEN o.tm >= s.done + {24 * _HOURS * 1000000} THEN 0 ELSE s.a END AS a2, o.attempt = (CASE WHEN o.tm >= s.done + {24 * _HOURS * 1000000} THEN 0 ELSE s.a END) AND o.attempt > 0 AS mine
   FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1) j),
 r AS (SELECT user_id, stale_a AS attempt, stale_at - {2 * _HOURS * 1000000} AS started, stale_at AS ended, 'stale' AS outcome FROM s WHERE stale_a IS NOT NULL
  UNION ALL SELECT user_id, out_a, out_started, ended, outcome FROM s WHERE outcome IS NOT NULL
  UNION ALL SELECT f.user_id, f.a, f.started, f.started + {2 * _HOURS * 1000000}, 'stale' FROM (SELECT s.*, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS z FROM s) f, (SELECT max(tm) AS last FROM o) WHERE z = 1 AND running AND last >= f.started + {2 * _HOURS * 1000000})
SELECT user_id, attempt, started, ended, outcome FROM r""")
def job_attempts(spark, d):
    """Every user a job, events as requests, results and failures; attempts are lost after two hours, done jobs forgotten after a day."""
    e = load(spark, d, "events")
    given = F.when(F.col("event_id") % 5 >= 3, F.col("event_id") % 3 + 1)
    # times without a zone are taken as they stand
    rows = e.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.expr(_KIND).alias("kind"), given.cast("int").alias("attempt"))
    last = rows.agg(F.max("ts")).first()[0]
    out = jobs.attempts(rows, "user_id", F.lit(last), 2 * _HOURS, 24 * _HOURS)
    micros = lambda c: F.unix_micros(F.col(c)).alias(c)
    return out.select("user_id", F.col("attempt").cast("long").alias("attempt"), micros("started"), micros("ended"), "outcome")


_ZONE_ROWS = ", ".join(f"({z.epsg}, '{z.name}', {z.bounds[0]}, {z.bounds[1]}, {z.bounds[2]}, {z.bounds[3]})" for z in E.ZONES)
_POINT = "-160 + (c_custkey * 7919 % 9301) / 100.0", "18 + (c_custkey * 104729 % 5003) / 100.0"


@query("state_plane_zone", f"""WITH p AS (SELECT c_custkey, {_POINT[0]} AS lon, {_POINT[1]} AS lat FROM customer), z AS (SELECT * FROM (VALUES {_ZONE_ROWS}) AS t(epsg, name, west, south, east, north)),
 m AS (SELECT c_custkey, epsg, name, row_number() OVER (PARTITION BY c_custkey ORDER BY (east - west) * (north - south), epsg) AS k FROM p JOIN z ON lon BETWEEN west AND east AND lat BETWEEN south AND north)
SELECT p.c_custkey, m.epsg, m.name AS zone_name FROM p LEFT JOIN m ON m.c_custkey = p.c_custkey AND k = 1""")
def state_plane_zone(spark, d):
    """Every customer a point in or around the United States, and the smallest zone that holds it."""
    c = load(spark, d, "customer").select("c_custkey", F.expr(_POINT[0]).cast("double").alias("lon"), F.expr(_POINT[1]).cast("double").alias("lat"))
    return Z.with_zone(c, Z.zone_index(spark, E.zones_frame(spark))).select("c_custkey", "epsg", "zone_name")


_CODES = [z.epsg for z in E.ZONES]
_NUMBERED = ", ".join(f"({k}, {z.epsg}, {(z.bounds[0] + z.bounds[2]) / 2}, {(z.bounds[1] + z.bounds[3]) / 2})" for k, z in enumerate(E.ZONES))


@query("printed_pair_zone", f"""WITH z AS (SELECT * FROM (VALUES {_NUMBERED}) AS t(k, epsg, lon, lat)) SELECT c_custkey, CAST(epsg AS INTEGER) AS epsg, round(lon + (c_custkey % 40 - 20) / 100.0, 6) AS lon, round(lat + (c_custkey % 30 - 15) / 100.0, 6) AS lat FROM customer JOIN z ON k = c_custkey % {len(_CODES)}""")
def printed_pair_zone(spark, d):
    """Every customer a printed pair of some zone, on ground level: of all zones of its state the one that gives the place back is first."""
    k = F.col("c_custkey")
    zones = E.zones_frame(spark)
    middle = zones.select("epsg", "state", ((F.col("west") + F.col("east")) / 2).alias("mlon"), ((F.col("south") + F.col("north")) / 2).alias("mlat"))
    codes = F.array(*map(F.lit, _CODES))
    c = load(spark, d, "customer").select("c_custkey", F.get(codes, (k % len(_CODES)).cast("int")).alias("epsg")).join(F.broadcast(middle), "epsg")
    c = c.withColumns({"lon": F.col("mlon") + (k % 40 - 20) / 100.0, "lat": F.col("mlat") + (k % 30 - 15) / 100.0})
    c = c.withColumn("g", E.lonlat_to_grid("epsg", "lon", "lat")).select("c_custkey", "state", (F.col("g.y") / 1.0002).alias("northing"), (F.col("g.x") / 1.0002).alias("easting"), F.lit(1.0002).alias("ground_to_grid"), F.col("lon").alias("alon"), F.col("lat").alias("alat"))
    found = placement.convert_state_plane(c, zones, ["c_custkey"]).filter("place = 0")
    return found.select("c_custkey", "epsg", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("area_km2", f"""WITH c AS (SELECT c_custkey, c_custkey % 3 AS kind, (c_custkey * 37 % 3600) / 10.0 - 180 AS lon, (c_custkey * 53 % 1600) / 10.0 - 80 AS lat, c_custkey % 170 + 1 AS width, {float(E.E)!r} AS e, {float(E.E2)!r} AS e2, {float(E.A)!r} AS a, {float(E.AUTHALIC2)!r} AS c2 FROM customer),
 b AS (SELECT *, sin(radians(lat - 0.05)) AS s1, sin(radians(lat + 0.05)) AS s2 FROM c)
SELECT c_custkey, round(CASE kind WHEN 0 THEN c2 * radians(width) WHEN 1 THEN 2 * pi() * c2 ELSE a * a * (1 - e2) / 2 * radians(0.1) * (s2 / (1 - e2 * s2 * s2) + atanh(e * s2) / e - s1 / (1 - e2 * s1 * s1) - atanh(e * s1) / e) END / 1e6, 3) AS area_km2 FROM b""")
def area_km2(spark, d):
    """Every customer a ring: from the equator to a pole, all round the equator, or a small box between parallels, over the antimeridian too."""
    k = F.col("c_custkey")
    lon, lat = (k * 37 % 3600) / 10.0 - 180, (k * 53 % 1600) / 10.0 - 80
    wrap = lambda x: (x + 540) % 360 - 180
    point = lambda x, y: _xy(wrap(x), y if isinstance(y, Column) else F.lit(float(y)))
    width = k % 170 + 1
    wedge = F.array(point(lon, 0), point(lon + width / 2, 0), point(lon + width, 0), point(lon + width, 90), point(lon, 90))
    round_ = F.array(*(point(lon + x, 0) for x in (0, 100, 170, 250)))
    side = lambda y, xs: F.transform(F.array(*map(F.lit, xs)), lambda x: point(lon + x, y))
    steps = [j / 160 - 0.05 for j in range(17)]
    box = F.concat(side(lat - 0.05, steps), side(lat + 0.05, steps[::-1]))
    ring = F.when(k % 3 == 0, wedge).when(k % 3 == 1, round_).otherwise(box)
    return spread(load(spark, d, "customer").select("c_custkey")).select("c_custkey", F.round(E.area_km2(ring), 3).alias("area_km2"))
