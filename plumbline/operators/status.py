"""Status trees: what may be trusted about a parcel, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def confirmed_placement(p: Column) -> Column:
    """Any placement that is trusted: by hand, a surveyed corner, a corroborated section part or county fit."""
    return _yes(p["anchor_override"]) | _yes(p["manual_position"]) | _yes(p["placement_status"] == "surveyed_corner") | _yes(p["aliquot_corroborated"]) | _yes(p["apn_corroborated"])


def calibration_gate(p: Column) -> Column:
    corroborated = _yes(p["aliquot_corroborated"]) | _yes(p["control_validated"]) | _yes(p["apn_corroborated"])
    return (
        F.when(~_yes(p["human_confirmed"]), "not_applicable")
        .when(_yes(p["calibration_status"] == "pending"), "pending")
        .when(_yes(p["calibration_status"].isin("cross_validated", "single_source")) | corroborated, "placeable")
        .otherwise("unconfirmed")
    )


def location_precision(p: Column) -> Column:
    return (
        F.when(_yes(p["anchor_override"]) | _yes(p["manual_position"]), "manual")
        .when(_yes(p["aliquot_corroborated"]), "aliquot")
        .when(_yes(p["control_validated"]), "control")
        .when(_yes(p["apn_corroborated"]), "apn")
        .when(_yes(p["human_confirmed"]) & _yes(p["anchor_precision"] == "surveyed") & ~confirmed_placement(p), "surveyed_anchor")
        .otherwise(p["anchor_precision"])
    )


def verdict(p: Column) -> Column:
    """What a reviewer is told about a parcel; the first rule that holds decides."""
    shape = _yes(p["shape_valid"])
    gate, precision = calibration_gate(p), location_precision(p)
    located = F.when(_yes(p["human_confirmed"]), confirmed_placement(p)).otherwise(_yes(precision.isin("surveyed", "manual")))
    return (
        F.when(_yes(p["awaiting_bind"]), "Confirming boundary…")
        .when(~_yes(p["human_confirmed"]), "Boundary not confirmed")
        .when(_yes(p["control_reading"]) & ~_yes(p["placement_status"] == "surveyed_corner") & ~_yes(p["apn_corroborated"]), "Refining placement…")
        .when((gate == "pending") | _yes(p["placement_status"] == "pending"), "Calibrating & placing…")
        .when(p["shape_valid"].isNull(), "Outline saved · not placed on the map")
        .when(_yes(p["manual_position"]) | _yes(p["anchor_override"]), F.when(shape, "Placed by hand").otherwise("Placed by hand · check area"))
        .when(gate == "unconfirmed", F.when(_yes(p["calibration_status"] == "unverified"), "Unconfirmed placement").otherwise("Unconfirmed placement · no anchor"))
        .when(shape & located, "Verified")
        .when(shape, "Shape OK · location approx.")
        .otherwise("Needs review")
    )


def placement_method(p: Column) -> Column:
    """(method, confirmed), from the strongest down."""
    rule = lambda m, ok: F.struct(F.lit(m).alias("method"), F.lit(ok).alias("confirmed"))
    return (
        F.when(_yes(p["anchor_override"]) | _yes(p["manual_position"]), rule("manual", True))
        .when(_yes(p["control_validated"]), rule("control", True))
        .when(_yes(p["apn_corroborated"]), rule("apn", True))
        .when(_yes(p["aliquot_corroborated"]), rule("aliquot", True))
        .when(_yes(p["placement_status"] == "surveyed_corner"), rule("surveyed_corner", True))
        .when(_yes(p["apn_fit"]), rule("apn_approx", False))
        .otherwise(rule("anchor", False))
    )


def can_write(is_sample: Column, is_sandbox: Column, owner: Column, user: Column, is_admin: Column) -> Column:
    return F.when(_yes(is_sample), _yes(is_admin)).when(_yes(is_sandbox), True).when(owner.isNotNull(), _yes(owner == user) | _yes(is_admin)).otherwise(_yes(is_admin))


#: Prefixes of validation issues and the buckets they count in.
ISSUE_BUCKETS = (("Weak closure", "weak_closure"), ("Traverse self-intersects", "self_intersection"), ("Walked area", "area_mismatch"), ("Only", "too_few_calls"))


def issue_bucket(text: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for prefix, name in ISSUE_BUCKETS:
        out = out.when(text.startswith(prefix), name)
    return out.otherwise("other")


def recheck_area(area: Column, stated: Column, tolerance: float = 0.15) -> Column:
    off = F.when(stated != 0, F.abs(area - stated) / stated)
    return F.struct(F.round(off * 100, 2).alias("area_diff_pct"), (off <= tolerance).alias("area_matches_stated"))
