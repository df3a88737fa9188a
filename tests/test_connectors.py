"""County records by number, and parcel files in two phases."""

import json
import os
import struct
import xml.dom.minidom

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringStartsWith

from plumbline.operators import views
from plumbline.sources import connectors as C


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("county") / "records")
    number = F.format_string("%03d-%03d-%02d", F.col("id") % 40, F.col("id") % 7, F.col("id") % 100)
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (0.01, 0.0), (0.01, 0.02))))
    rows = spark.range(900).select(number.alias("apn"), F.when(F.col("id") % 5 > 0, F.concat(F.lit('O"wner\n\t'), "id")).alias("owner"), F.lit("é").alias("address"), F.when(F.col("id") % 9 > 0, ring).alias("ring"))
    C.save_records(rows.unionByName(rows.limit(1).withColumn("apn", F.lit(None).cast("string"))), path, 8)
    return path, [tuple(r) for r in rows.collect()]


def test_all_records_come_back(spark, store):
    path, rows = store
    assert sorted(map(str, map(tuple, C.county_records(spark, path).collect()))) == sorted(map(str, rows))


def reader(path, *filters):
    r = C.RecordReader(path)
    return r, list(r.pushFilters(list(filters)))


def test_only_asked_numbers_are_read(store):
    """Files out of range are not opened, and of the others only asked lines become rows."""
    path, rows = store
    everything, _ = reader(path)
    assert len(everything.partitions()) == 8
    some = sorted({r[0] for r in rows})
    r, left = reader(path, EqualTo(("apn",), some[5]), StringStartsWith(("owner",), "O"))
    assert len(r.partitions()) <= 2 and [type(f) for f in left] == [StringStartsWith]
    assert {x[0] for p in r.partitions() for x in r.read(p)} == {some[5]}
    r, left = reader(path, In(("apn",), (some[0], some[-1], "nonsense", None)))
    got = [x[0] for p in r.partitions() for x in r.read(p)]
    assert not left and 2 <= len(r.partitions()) <= 4 and set(got) == {some[0], some[-1]} and len(got) == sum(x[0] in (some[0], some[-1]) for x in rows)
    r, left = reader(path, GreaterThan(("apn",), some[100]), LessThanOrEqual(("apn",), some[110]))
    assert {x[0] for p in r.partitions() for x in r.read(p)} == set(some[101:111]) and len(r.partitions()) < 5 and not left
    r, _ = reader(path, EqualTo(("apn",), some[1]), EqualTo(("apn",), some[2]))
    assert not r.partitions()


def test_filters_in_spark(spark, store):
    path, rows = store
    wanted = [rows[3][0], rows[77][0], "none"]
    df = C.county_records(spark, path, wanted)
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(r) for r in rows if r[0] in wanted)
    assert df.filter("owner is null and apn > '020'").count() == sum(r[0] in wanted and r[1] is None and r[0] > "020" for r in rows)
    assert df.rdd.getNumPartitions() <= 4 and C.county_records(spark, path).rdd.getNumPartitions() == 8
    with pytest.raises(ValueError):
        C.county_records(spark, path, ["x"] * 1001)


def test_records_feed_the_lookup(spark, store):
    """Numbers that a plat prints, found through the source."""
    path, rows = store
    there = next(r[0] for r in rows if r[3])
    wanted = spark.createDataFrame([("d", 1, 0, there, "subject", None), ("d", 1, 1, "999-999-99", "neighbour", "N")], "document_id string, page_number int, pos int, apn string, role string, side string")
    centres = spark.createDataFrame([("d", 1, 0.0, 0.0)], "document_id string, page_number int, lon double, lat double")
    found, pages = views.county_numbers(wanted, C.county_records(spark, path, [there, "999-999-99"]), centres)
    assert [(r["apn"], r["found"]) for r in found.orderBy("pos").collect()] == [(there, True), ("999-999-99", False)]
    assert pages.first()["found"] == 1


# files

SCHEMA = "document_id string, id int, label string, area double, ring array<struct<x:double,y:double>>"


def parcels(spark, n=40):
    ring = lambda k: [{"x": float(k), "y": 0.0}, {"x": k + 1.0, "y": 0.0}, {"x": k + 1.0, "y": 2.0}]
    rows = [(f"doc {k % 3}", k, f"Lot {k} <&> é" + "x" * 300 * (k == 7), None if k == 4 else k / 3, ring(k)) for k in range(n)]
    rows += [(None, 99, None, 1.0, ring(5)), ("doc 0", 100, "no ring", 1.0, None), ("doc 9", 101, "thin", 1.0, ring(1)[:2])]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if not f.startswith("."))


def test_geojson_files(spark, tmp_path):
    path = str(tmp_path / "out")
    C.save_parcels(parcels(spark), path, "geojson")
    found = {}
    for f in files(path):
        collection = json.load(open(f, encoding="utf-8"))
        found.setdefault(os.path.basename(os.path.dirname(f)), []).extend(x["properties"]["id"] for x in collection["features"])
        assert all(x["geometry"]["coordinates"][0][0] == x["geometry"]["coordinates"][0][-1] for x in collection["features"])
    assert {k: sorted(v) for k, v in found.items()} == {"document_id=none": [99], **{f"document_id=doc%20{d}": list(range(d, 40, 3)) for d in range(3)}}
    assert len(files(path)) == 4 and not [f for f in files(path) if "_staged" in f]
    C.save_parcels(parcels(spark), path, "geojson")
    assert len(files(path)) == 8
    C.save_parcels(parcels(spark), path, "geojson", mode="overwrite", parts=3)
    assert 4 < len(files(path)) <= 10 and sum(len(json.load(open(f))["features"]) for f in files(path)) == 41


def test_kml_files(spark, tmp_path):
    path = str(tmp_path / "out")
    C.save_parcels(parcels(spark), path, "kml")
    marks = [m for f in files(path) for m in xml.dom.minidom.parse(f).getElementsByTagName("Placemark")]
    assert len(marks) == 41 and any("Lot 3 <&> é" in m.getElementsByTagName("name")[0].firstChild.data for m in marks if m.getElementsByTagName("name")[0].firstChild)


def test_shapefiles(spark, tmp_path):
    path = str(tmp_path / "out")
    C.save_parcels(parcels(spark), path, "shapefile", prj="GEOGCS[x]")
    stems = {f.rpartition(".")[0] for f in files(path)}
    assert len(stems) == 4 and len(files(path)) == 20
    total = 0
    for stem in stems:
        shp, shx, dbf = (open(f"{stem}.{s}", "rb").read() for s in ("shp", "shx", "dbf"))
        assert struct.unpack(">i", shp[24:28])[0] * 2 == len(shp) and struct.unpack(">i", shx[24:28])[0] * 2 == len(shx)
        n = (len(shx) - 100) // 8
        total += n
        at, boxes = 100, []
        for k in range(n):
            offset, words = struct.unpack(">2i", shx[100 + 8 * k : 108 + 8 * k])
            number, length = struct.unpack(">2i", shp[at : at + 8])
            assert (offset * 2, words, number) == (at, length, k + 1)
            boxes.append(struct.unpack("<4d", shp[at + 12 : at + 44]))
            at += 8 + 2 * length
        assert at == len(shp) and struct.unpack("<4d", shp[36:68]) == tuple(f(b[i] for b in boxes) for i, f in enumerate((min, min, max, max)))
        rows, head, size = struct.unpack("<IHH", dbf[4:12])
        assert rows == n and len(dbf) == head + rows * size + 1 and dbf[-1] == 0x1A
        assert open(f"{stem}.prj").read() == "GEOGCS[x]"
    assert total == 41


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    """One task fails after others have written: nothing is left, and what was there before stays."""
    path = str(tmp_path / "out")
    C.save_parcels(parcels(spark), path, "geojson")
    before = files(path)
    broken = parcels(spark).withColumn("area", F.when(F.col("id") == 20, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("area")))
    for mode in ("append", "overwrite"):
        with pytest.raises(PySparkException):
            C.save_parcels(broken, path, "geojson", mode=mode)
        assert files(path) == before and not any(n.startswith("_staged") for n in os.listdir(path))
    with pytest.raises(PySparkException):
        C.save_parcels(parcels(spark), str(tmp_path / "other"), "dxf")
