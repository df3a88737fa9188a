"""Sinks: GeoJSON, KML, CSV, shapefile and metadata of a report."""

from __future__ import annotations

import io
import struct
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.report import attribute_rows, call_rows, vertex_rows
from . import shapes

#: Line colours (alpha, blue, green, red) that placemarks cycle through.
KML_COLOURS = ("ff0000ff", "ff00ff00", "ffff0000", "ff00ffff", "ffff00ff", "ffffff00", "ff0080ff", "ff8000ff")


def geojson(report: DataFrame) -> DataFrame:
    """One feature a parcel: attributes and ring."""
    ring = F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"])))
    rows = attribute_rows(report)
    named = report.select(F.col("id").alias("ParcelID"), "document_id", F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"))
    return rows.join(named, "ParcelID").select("document_id", "ParcelID", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*rows.columns).alias("properties"), "geometry")).alias("feature"))


def geojson_collection(report: DataFrame) -> DataFrame:
    f = geojson(report).groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ParcelID", "feature"))), lambda s: s["feature"]), ",").alias("f"))
    return f.select("document_id", F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("collection"))


def _xml(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def kml(report: DataFrame) -> DataFrame:
    """A placemark a parcel, coordinates with nine decimals, colours in turn."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("document_id").orderBy("id")) - 1
    colour = F.get(F.array(*map(F.lit, KML_COLOURS)), (n % len(KML_COLOURS)).cast("int"))
    line = F.array_join(F.transform("ring", lambda p: F.format_string("%.9f,%.9f,0", p["x"], p["y"])), " ")
    return report.select("document_id", "id", F.concat(F.lit("<Placemark><name>"), _xml(F.coalesce("label", F.lit(""))), F.lit("</name><Style><LineStyle><color>"), colour, F.lit("</color></LineStyle></Style><Polygon><outerBoundaryIs><LinearRing><coordinates>"), line, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>")).alias("placemark"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_tables(report: DataFrame, parcels: DataFrame, path: str) -> None:
    """Attribute, vertex and course tables of a report below ``path``."""
    for name, rows in (("attributes", attribute_rows(report)), ("vertices", vertex_rows(report)), ("calls", call_rows(parcels))):
        write_csv(rows, f"{path}/{name}")


def metadata(report: DataFrame) -> DataFrame:
    """Extent and lineage of each document's report as JSON."""
    at = report.select("document_id", F.explode("ring").alias("p")).groupBy("document_id").agg(F.struct(F.min("p.x").alias("west"), F.min("p.y").alias("south"), F.max("p.x").alias("east"), F.max("p.y").alias("north")).alias("extent"))
    n = report.groupBy("document_id").agg(F.count(F.lit(1)).alias("parcels"))
    return at.join(n, "document_id").select("document_id", F.to_json(F.struct(F.lit("dataset").alias("scope"), "extent", "parcels", F.lit("EPSG:4326").alias("reference_system"))).alias("metadata"))


def shapefile_zip(rows: list[dict], prj: str) -> bytes:
    """One document's parcels (attributes and ``ring``) as a zipped shapefile: clockwise rings, numbers N(18,3), texts C(254)."""
    body, index, extent, at = io.BytesIO(), io.BytesIO(), None, 50
    for k, r in enumerate(rows, 1):
        record, box = shapes.polygon(k, [(p["x"], p["y"]) for p in r["ring"]])
        body.write(record)
        index.write(struct.pack(">2i", at, len(record) // 2 - 4))
        at, extent = at + len(record) // 2, shapes.joined(extent, box)
    names = [c for c in (rows[0] if rows else {}) if c != "ring"]
    columns = [(c, all(isinstance(r[c], (int, float)) or r[c] is None for r in rows)) for c in names]
    dbf = shapes.table_header(len(rows), columns) + b"".join(shapes.table_row([r[c] for c in names], columns) for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in (("shp", shapes.header(at, extent) + body.getvalue()), ("shx", shapes.header(50 + 4 * len(rows), extent) + index.getvalue()), ("dbf", dbf + b"\x1a"), ("prj", prj.encode()), ("cpg", b"UTF-8")):
            z.writestr(f"parcels.{name}", data)
    return out.getvalue()


# whole documents

#: What a report is exported as, with the ending of its file.
FORMATS = {"geojson": "geojson", "kml": "kml", "attributes": "csv", "vertices": "csv", "calls": "csv", "metadata": "json", "shapefile": "zip", "package": "zip"}
_BOM = "﻿"


def file_stem(name):
    """A document's name as a file name: 60 characters at most, none that a file system dislikes."""
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(F.trim(name), r"[^A-Za-z0-9._-]+", "_"), 1, 60), F.lit("")), F.lit("report"))


def csv_text(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One CSV text (header, byte order mark) for each ``key`` of ``rows``."""
    columns = [c for c in rows.columns if c != key]
    line = F.to_csv(F.struct(*columns))
    text = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate(order)), line.alias("line")))).alias("l"))
    return text.select(key, F.concat(F.lit(_BOM + ",".join(columns) + "\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("content"))


def _kml_document(report: DataFrame) -> DataFrame:
    marks = kml(report).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("id", "placemark"))).alias("p"))
    head, tail = '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>', "</Document></kml>"
    return marks.select("document_id", F.concat(F.lit(head), F.array_join(F.transform("p", lambda x: x["placemark"]), ""), F.lit(tail)).alias("content"))


def _shapefiles(report: DataFrame, prj: str) -> DataFrame:
    rows = attribute_rows(report)
    both = rows.join(report.select(F.col("id").alias("ParcelID"), "document_id", "ring"), "ParcelID")

    def run(pdf):
        import pandas as pd

        own = pdf.sort_values("ParcelID")
        records = [{k: (None if v is None or v != v else v) for k, v in r.items() if k not in ("document_id", "ring")} | {"ring": list(ring)} for r, ring in zip(own.drop(columns="ring").to_dict("records"), own["ring"])]
        return pd.DataFrame({"document_id": own["document_id"].iloc[:1], "content": [shapefile_zip(records, prj)]})

    kind = report.schema["document_id"].dataType.simpleString()
    return both.groupBy("document_id").applyInPandas(run, f"document_id {kind}, content binary")


def exported(report: DataFrame, parcels: DataFrame, kind: str, prj: str | None = None) -> DataFrame:
    """document_id, name and content (bytes) of every document's report (document_id, id, ring ...) in one of ``FORMATS``.

    ``parcels`` (document_id, id, calls) gives the courses; ``prj`` is the system of the shapefile, without which a package has
    none.  Documents without parcels have no file.
    """
    text = lambda df, c: df.select("document_id", F.col(c).cast("binary").alias("content"))
    if kind == "geojson":
        out = text(geojson_collection(report), "collection")
    elif kind == "kml":
        out = text(_kml_document(report), "content")
    elif kind == "attributes":
        named = attribute_rows(report).join(report.select(F.col("id").alias("ParcelID"), "document_id"), "ParcelID")
        out = text(csv_text(named, "document_id", ["ParcelID"]), "content")
    elif kind == "vertices":
        out = text(csv_text(vertex_rows(report), "document_id", ["id", "vertex"]), "content")
    elif kind == "calls":
        out = text(csv_text(call_rows(parcels), "document_id", ["id", "course"]), "content")
    elif kind == "metadata":
        out = text(metadata(report), "metadata")
    elif kind == "shapefile":
        out = _shapefiles(report, prj or "")
    elif kind == "package":
        return _packages(report, parcels, prj)
    else:
        raise ValueError(f"unknown format {kind!r}; known are {', '.join(FORMATS)}")
    return out.select("document_id", F.concat(file_stem(F.col("document_id").cast("string")), F.lit(f"_{kind}.{FORMATS[kind]}")).alias("name"), "content")


def _packages(report: DataFrame, parcels: DataFrame, prj: str | None) -> DataFrame:
    """One archive a document that holds its other files."""
    kinds = [k for k in FORMATS if k != "package" and (k != "shapefile" or prj)]
    files = None
    for k in kinds:
        one = exported(report, parcels, k, prj)
        files = one if files is None else files.unionByName(one)
    files = files.join(report.select("document_id").distinct(), "document_id", "left_semi")

    @F.pandas_udf("binary")
    def bundle(listed):
        import pandas as pd

        def one(entries):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for e in entries:
                    z.writestr(zipfile.ZipInfo(e["name"]), bytes(e["content"]))
            return out.getvalue()

        return pd.Series([one(e) for e in listed])

    listed = files.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("name", "content"))).alias("files"))
    return listed.select("document_id", F.concat(file_stem(F.col("document_id").cast("string")), F.lit("_package.zip")).alias("name"), bundle("files").alias("content"))
