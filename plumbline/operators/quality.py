"""Data-quality predicates of record types, scoring against labels, and the function registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geodesy as E
from ..functions import text as T

#: Ranges that records must keep.
RULES: dict[str, Callable[[], Column]] = {
    "latitude": lambda: F.col("latitude").between(-90, 90),
    "longitude": lambda: F.col("longitude").between(-180, 180),
    "rating": lambda: F.col("rating").isNull() | F.col("rating").between(0, 5),
    "review_count": lambda: F.col("review_count").isNull() | (F.col("review_count") >= 0),
    "distance_m": lambda: F.col("distance_m").isNull() | (F.col("distance_m") >= 0),
}


def with_violations(records: DataFrame) -> DataFrame:
    """``records`` and the names of the rules they break; a missing mandatory value breaks its rule."""
    named = [F.when(~F.coalesce(rule(), F.lit(False)), F.lit(n)) for n, rule in RULES.items() if n in records.columns]
    return records.withColumn("violations", F.array_compact(F.array(*named)) if named else F.array().cast("array<string>"))


def score_regions(regions: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts by labelled category: ``regions`` (document_id, page, box, parcels, parcels_3plus, valid, triaged, error) and ``labels`` (document_id, page, box, category).

    ``box`` is the rounded box as a string; regions without a label count as unlabeled.
    """
    j = regions.join(labels, ["document_id", "page", "box"], "left").withColumn("category", F.coalesce("category", F.lit("unlabeled")))
    return j.groupBy("category").agg(F.count(F.lit(1)).alias("regions"), F.count_if("triaged").alias("triaged_out"), F.sum("parcels").alias("parcels"), F.sum("parcels_3plus").alias("parcels_3plus"), F.sum("valid").alias("valid"), F.count_if("error").alias("errors"))


def rate(part: Column, whole: Column) -> Column:
    """Three decimals; null without a whole."""
    return F.bround(F.try_divide(part.cast("double"), whole.cast("double")), 3)


def closed(parsed_calls: Column, area: Column, precision: Column) -> Column:
    return F.coalesce((parsed_calls >= 3) & (area > 0) & (precision.isNull() | (precision >= 500)), F.lit(False))


#: Scalar functions by their public names.
FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "cogo_azimuth": T.azimuth,
    "cogo_distance": T.distance,
    "cogo_delta": T.delta,
    "acres_to_sqft": T.acres_to_sqft,
    "area_km2": E.area_km2,
}


def call(df: DataFrame, name: str, column: str, to: str) -> DataFrame:
    """``df`` with ``to`` from a registered function; an unknown name is an error."""
    if name not in FUNCTIONS:
        raise KeyError(f"unknown function: {name}")
    return df.withColumn(to, FUNCTIONS[name](F.col(column)))


def register(spark) -> None:
    """The geodesic area as a SQL function; the text readers are Column functions and need no registration."""
    spark.udf.register("area_km2", E.area_km2)


def tool_specs(spark) -> DataFrame:
    """Names and result types of the registered functions."""
    rows = [(n, spark.range(1).select(F.lit("N 1°E").alias("s")).select(f(F.col("s")).alias("v")).schema["v"].dataType.simpleString()) for n, f in FUNCTIONS.items() if n != "area_km2"]
    return spark.createDataFrame([*rows, ("area_km2", "double")], "name string, returns string")


def coerce_number(text: Column) -> Column:
    """Numeric strings with separators as numbers; anything else null, never an error."""
    return F.replace(F.trim(text), F.lit(",")).try_cast("double")
