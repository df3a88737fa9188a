"""Hypothetical moves of a sheet's outlines among county parcels: how well they would sit, and where to look."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.session import spread
from . import overlay
from . import placement as P

EVALUATION = "overlap_pct double, hugging_pct double, mean_gap_m double, nearest_edge_m double, neighbour_count int"


def offset(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """(east_m, north_m, distance_m) to one decimal."""
    e, n = (lon2 - lon1) * G.M_PER_DEG_LON * F.cos(F.radians((lat1 + lat2) / 2)), (lat2 - lat1) * G.M_PER_DEG_LAT
    return F.struct(F.round(e, 1).alias("east_m"), F.round(n, 1).alias("north_m"), F.round(F.hypot(e, n), 1).alias("distance_m"))


def direction_text(east: Column, north: Column) -> Column:
    """"12 m north, 3 m east": parts of half a metre or more."""
    part = lambda v, plus, minus: F.when(F.abs(v) >= 0.5, F.format_string("%.0f m %s", F.abs(v), F.when(v > 0, plus).otherwise(minus)))
    return F.concat_ws(", ", part(north, "north", "south"), part(east, "east", "west"))


def _local(rings, lon0: float, lat0: float) -> list[np.ndarray]:
    k = np.array([G.M_PER_DEG_LON * np.cos(np.radians(lat0)), G.M_PER_DEG_LAT])
    return [(np.array([(p["x"], p["y"]) for p in r], float) - (lon0, lat0)) * k for r in rings]


def evaluate(rings, neighbours, east: float, north: float, turn: float) -> tuple:
    pts = np.array([(p["x"], p["y"]) for r in rings for p in r], float)
    lon0, lat0 = pts.mean(0)
    group, others = _local(rings, lon0, lat0), _local([n for n in neighbours if len(n) >= 4], lon0, lat0)
    if not others or not group:
        return (None, None, None, None, len(others))
    pivot = P._middle(group)
    moved = [P._rotate(r, turn, pivot) + (east, north) for r in group]
    share = P._share(overlay.Side(moved), overlay.Side(others))
    d = P._edge_distance(P._samples(moved), others, np.inf)
    return (round(share * 100, 1), round(float((d <= P.HUG_M).mean()) * 100, 1), round(float(np.minimum(d, P.GAP_CAP_M).mean()), 2), round(float(d.min()), 1), len(others))


def evaluate_positions(moves: DataFrame, keys: list[str]) -> DataFrame:
    """Fit of each row's hypothetical move: keys, rings, neighbours, east_m, north_m, rotation_deg."""
    names = [c.split()[0] for c in EVALUATION.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [(*(r[k] for k in keys), *evaluate(r["rings"], r["neighbours"], r["east_m"], r["north_m"], r["rotation_deg"])) for r in pdf.to_dict("records")]
            yield pd.DataFrame(rows, columns=[*keys, *names])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moves.schema.fields if f.name in keys) + ", " + EVALUATION
    return spread(moves.select(*keys, "rings", "neighbours", "east_m", "north_m", "rotation_deg"), *keys).mapInPandas(run, schema)


def search_near(starts: DataFrame, keys: list[str]) -> DataFrame:
    """County fit from a first move: total move, fit and whether it lies at the edge of the search."""
    lat = F.get(F.get("rings", 0), 0)["y"]
    dx, dy = F.col("east_m") / (G.M_PER_DEG_LON * F.cos(F.radians(lat))), F.col("north_m") / G.M_PER_DEG_LAT
    moved = starts.withColumn("rings", F.transform("rings", lambda r: G.translate_ring(r, dx, dy)))
    fit = P.apn_fits(moved, keys)
    j = fit.withColumnRenamed("east_m", "fit_e").withColumnRenamed("north_m", "fit_n").join(starts.select(*keys, "east_m", "north_m"), keys)
    edge = (F.abs("fit_e") >= P.SEARCH_M - 1) | (F.abs("fit_n") >= P.SEARCH_M - 1)
    return j.select(*keys, F.round(F.col("east_m") + F.col("fit_e"), 1).alias("total_east_m"), F.round(F.col("north_m") + F.col("fit_n"), 1).alias("total_north_m"), "rotation_deg", "mode", "overlap", "hugging", "corroborated", edge.alias("at_search_edge"))


def max_spread(points: DataFrame, keys: list[str]) -> DataFrame:
    """Largest distance between two points (lon, lat) of a key, over the corners of its bounding directions.

    The extremes in 16 directions hold the farthest pair to within 0.5 %, without pairing all points.
    """
    angles = [k * np.pi / 16 for k in range(16)]
    k = G.M_PER_DEG_LON
    x, y = F.col("lon") * k * F.cos(F.radians(F.lit(1.0) * F.col("lat"))), F.col("lat") * G.M_PER_DEG_LAT
    along = [x * float(np.cos(a)) + y * float(np.sin(a)) for a in angles]
    return points.groupBy(*keys).agg(F.greatest(*(F.max(a) - F.min(a) for a in along)).alias("spread_m"))
