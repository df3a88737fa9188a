"""Answers of recognition models (JSON text) as rows: what is malformed or out of range is left out, nothing is invented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .evidence import sanitize_location
from .sheets import sanitize_roster

#: What a sheet can be.
SHEET_ROLES = ("target_parcel_map", "reference_survey", "other_parcel_drawing", "location_or_aerial_map", "not_a_map")


def _items(answers: DataFrame, fields: str) -> DataFrame:
    """One row for each answer about an image: ``pos`` in the payload and ``image`` from 0, if it is one of the ``count`` images sent.

    ``answers``: key columns, payload (a JSON array), count.
    """
    keys = [c for c in answers.columns if c not in ("payload", "count")]
    rows = answers.select(*keys, "count", F.posexplode(F.from_json("payload", f"array<struct<image_number:int,{fields}>>")).alias("pos", "a"))
    image = F.col("a.image_number") - 1
    return rows.filter((image >= 0) & (image < F.col("count"))).select(*keys, image.alias("image"), "pos", "a")


def _last(rows: DataFrame, values: list[str]) -> DataFrame:
    """The last answer about each image."""
    keys = [c for c in rows.columns if c not in ("pos", *values)]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "pos").alias("v"))
    return last.select(*keys, *(F.col(f"v.{v}").alias(v) for v in values))


def sheet_roles(answers: DataFrame) -> DataFrame:
    """Role and reason (or null) of each image of ``answers`` (keys, payload, count); unknown roles are no answer."""
    rows = _items(answers, "role:string,reason:string").filter(F.col("a.role").isin(*SHEET_ROLES))
    return _last(rows.withColumns({"role": F.col("a.role"), "reason": T.clean_text(F.col("a.reason"))}).drop("a"), ["role", "reason"])


def rosters(answers: DataFrame) -> DataFrame:
    """Parcels (page_number = image, pos, label, printed_id, stated_area) listed for each image of ``answers`` (document_id, payload, count), cleaned as entities."""
    parcels = "parcels:array<struct<label:string,printed_id:string,stated_area:string>>"
    rows = _last(_items(answers, parcels).withColumn("parcels", F.col("a.parcels")).drop("a"), ["parcels"])
    listed = rows.select("document_id", F.col("image").alias("page_number"), F.posexplode("parcels").alias("pos", "p"))
    listed = listed.select("document_id", "page_number", "pos", T.clean_text(F.col("p.label")).alias("label"), F.col("p.printed_id").alias("printed_id"), T.clean_text(F.col("p.stated_area")).alias("stated_area"))
    return sanitize_roster(listed)


def roster_locations(answers: DataFrame) -> DataFrame:
    """Location evidence (not yet verified) of each image of ``answers`` (keys, payload, count) whose answer has one."""
    rows = _items(answers, "location:string").filter(F.trim("a.location").startswith("{"))
    return _last(rows.withColumn("location", sanitize_location(F.col("a.location"))).drop("a"), ["location"])


def edge_labels(payload: Column, n_edges: Column) -> Column:
    """Array of (edge_index, value, azimuth, bearing_text): edges of the outline with a positive distance.

    A NUL stands where some answers lose the degree sign.  A distance that is no number leaves the edge out, a bearing
    that cannot be read is null.
    """
    edges = F.coalesce(F.from_json(payload, "struct<edges:array<struct<edge_index:int,distance_ft:double,bearing_text:string>>>")["edges"], F.array())
    d = lambda e: e["distance_ft"]
    good = F.filter(edges, lambda e: (e["edge_index"] >= 0) & (e["edge_index"] < n_edges) & (d(e) > 0) & (d(e) < float("inf")) & ~F.isnan(d(e)))
    bearing = lambda e: F.replace(e["bearing_text"], F.lit("\x00"), F.lit("°"))
    return F.transform(good, lambda e: F.struct(e["edge_index"].alias("edge_index"), d(e).alias("value"), T.azimuth(bearing(e)).alias("azimuth"), bearing(e).alias("bearing_text")))
