"""Whose survey it is: country signals, national grids, plan numbers and fuzzy place names."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import geodesy as E
from . import placement as P

#: Printed signals of a country.
SIGNALS = {
    "US": (r"\bAPN\b", r"\bNAD ?83\b", r"\bstate plane\b", r"\bcounty recorder\b", r"\bT\d+[NS]\b.*\bR\d+[EW]\b", r"\bPLSS\b"),
    "CA": (r"\bconcession\b", r"\bontario\b", r"\bregistered plan\b", r"\bMTM\b", r"\bCSRS\b", r"\b[A-Z]\d[A-Z] ?\d[A-Z]\d\b"),
    "NZ": (r"\bDP ?\d{4,6}\b", r"\bNZGD", r"\bNZTM\b", r"\bLINZ\b", r"land information new zealand", r"\bnew zealand\b"),
    "GB": (r"HM Land Registry", r"\btitle number\b", r"\bOSGB", r"\bordnance survey\b", r"\b[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}\b"),
    "AU": (r"\bGDA ?(94|2020)\b", r"\bMGA\b", r"\bSP ?\d{5,6}\b", r"\bLRS\b"),
}


def country_votes(text: Column) -> Column:
    """Array of (country, signals), in the order above."""
    return F.array(*(F.struct(F.lit(c).alias("country"), sum((F.when(text.rlike("(?i)" + p), 1).otherwise(0) for p in ps), F.lit(0)).alias("n")) for c, ps in SIGNALS.items()))


def country(text: Column) -> Column:
    """The country with most signals, the first of equals; null without any."""
    votes = F.filter(country_votes(text), lambda v: v["n"] > 0)
    ranked = F.array_sort(F.transform(votes, lambda v, i: F.struct((-v["n"]).alias("k"), i.alias("i"), v["country"].alias("country"))))
    return F.get(ranked, 0)["country"]


def os_grid(ref: Column) -> Column:
    """(easting, northing) of the centre of an Ordnance Survey square such as SK3390SW."""
    p = r"(?i)^\s*([HJNOST])([A-HJ-Z])\s*(\d{2})\s*(\d{2})\s*(NE|NW|SE|SW)?\s*$"
    part = lambda i: F.upper(F.regexp_extract(ref, p, i))
    index = lambda c: F.instr(F.lit("ABCDEFGHJKLMNOPQRSTUVWXYZ"), c) - 1
    a, b, quad = index(part(1)), index(part(2)), part(5)
    e = (F.pmod(a - 2, F.lit(5)) * 5 + b % 5) * 100_000 + part(3).cast("int") * 1000
    n = (19 - F.floor(a / 5) * 5 - F.floor(b / 5)) * 100_000 + part(4).cast("int") * 1000
    half = lambda letter: F.when(quad == "", 500).otherwise(F.when(quad.contains(letter), 500).otherwise(0) + 250)
    return F.when(ref.rlike(p), F.struct((e + half("E")).cast("double").alias("easting"), (n + half("N")).cast("double").alias("northing")))


#: The national grid of Great Britain (Airy ellipsoid; the datum shift of about 100 m is not applied).
BRITISH_GRID = E.Zone(27700, "OSGB 1936 / British National Grid", "", "tm", 49.0, -2.0, 0.9996012717, 400_000.0, -100_000.0, unit=1.0)


def plan_appellations(appellations: Column, lots: Column, plan: Column) -> Column:
    """Names to look up: lots with printed areas on the plan first, then appellations, six at most."""
    p = F.upper(F.trim(F.regexp_replace(plan, r"\s+", " ")))
    bare = lambda x: x.rlike(r"(?i)^lot \d+$")
    clean = F.transform(appellations, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    named = F.transform(F.filter(clean, lambda x: (bare(x) & p.isNotNull()) | x.rlike(r"(?i)\bDP \d+")), lambda x: F.when(bare(x), F.concat(F.initcap(x), F.lit(" "), p)).otherwise(x))
    first = F.transform(F.filter(lots, lambda x: bare(F.trim(x)) & p.isNotNull()), lambda x: F.concat(F.initcap(F.trim(x)), F.lit(" "), p))
    return F.slice(F.array_distinct(F.concat(F.reverse(first), named)), 1, 6)


def plan_anchor(found: DataFrame) -> DataFrame:
    """Mean centre of the parcels a plan names (document_id, appellation, lon, lat, titles, area_m2, printed_m2, record_titles)."""
    match = F.array_intersect(F.transform(F.split(F.coalesce("titles", F.lit("")), ","), F.trim), F.coalesce("record_titles", F.array().cast("array<string>")))
    f = found.withColumn("match", F.filter(match, lambda x: x != ""))
    return f.groupBy("document_id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.sort_array(F.collect_list("appellation")).alias("parcels_found"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("match")))).alias("title_matches"), F.count_if(F.abs(F.col("area_m2") - F.col("printed_m2")) <= 0.01 * F.col("printed_m2")).alias("areas_agree"))


def name_ratios(pairs: DataFrame) -> DataFrame:
    """``pairs`` (name, option and others) with ``score``, the longest-matching-blocks ratio without regard to case."""

    def run(batches):
        for pdf in batches:
            score = [SequenceMatcher(None, str(a).lower(), str(b).lower()).ratio() for a, b in zip(pdf["name"], pdf["option"])]
            yield pdf.assign(score=score)

    pairs = pairs.drop("score")
    return pairs.mapInPandas(run, StructType([*pairs.schema.fields, StructField("score", DoubleType())]))


def best_name(pairs: DataFrame, keys: list[str], floor: float = 0.75) -> DataFrame:
    """Best fuzzy match of ``name`` among ``option`` per key; below the floor none."""
    scored = name_ratios(pairs)
    return scored.filter(F.col("score") >= floor).groupBy(*keys).agg(F.max_by(F.struct("option", "score"), F.struct("score", F.lit(0)))["option"].alias("option"), F.max("score").alias("score"))


def outward_samples(rings: DataFrame, step_m: float, offset_m: float) -> DataFrame:
    """Points every ``step_m`` along each ring (document_id, ring in local metres), moved outwards by ``offset_m``."""
    def run(batches):
        for pdf in batches:
            rows = []
            for d, ring in zip(pdf["document_id"], pdf["ring"]):
                p = np.array([(v["x"], v["y"]) for v in ring], float)
                q = np.roll(p, -1, axis=0)
                sign = 1.0 if (p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() > 0 else -1.0
                at = P._samples([p], step_m)
                nxt = np.roll(at, -1, axis=0) - at
                n = np.hypot(*nxt.T)
                out = at + offset_m * sign * np.column_stack([nxt[:, 1], -nxt[:, 0]]) / np.where(n > 0, n, 1)[:, None]
                rows += [(d, float(x), float(y)) for x, y in out]
            yield pd.DataFrame(rows, columns=["document_id", "x", "y"])

    kind = rings.schema["document_id"].dataType.simpleString()
    return rings.select("document_id", "ring").mapInPandas(run, f"document_id {kind}, x double, y double")


def agreement(printed: Column, found: Column, overlap: Column) -> Column:
    """Georeferencing status by area difference (1, 15, 50 %) and neighbour overlap (60 %)."""
    off = F.abs(printed - found) / printed
    return F.when(off <= 0.01, "exact").when((off <= 0.15) & (overlap >= 0.6), "corroborated").when(off <= 0.5, "plausible").otherwise("rejected")
