"""Data sources in Python: county records by number, with filters pushed to the files, and parcel files written in two phases.

``county_records``: records (apn, owner, address, ring) in text files sorted by number, and a manifest of each file's range.
Filters on the number (equal, in, bounds) reach the reader: files whose range holds no asked number are not opened, and of the
others only asked lines are parsed.  The session must allow it (``spark.sql.python.filterPushdown.enabled``); ``county_records`` sets that.

``parcel_files``: GeoJSON, KML or shapefiles, one for each document and task, written row by row.  Tasks write below a staging folder of
the job; commit moves their files to their places, abort removes the folder, so a failed task or job leaves no file behind.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import escape

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import NumericType, StructType

from . import shapes
from .exports import KML_COLOURS

RECORD = "apn string, owner string, address string, ring array<struct<x:double,y:double>>"
MANIFEST = "_ranges.json"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def files_of(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


# county records


def save_records(records: DataFrame, path: str, files: int) -> None:
    """Write records (RECORD) below ``path`` in about ``files`` files of ascending ranges of numbers; those without a number are left out."""
    job = uuid.uuid4().hex[:12]

    def write(batches):
        import pyarrow as pa

        fs, root = files_of(path)
        fs.create_dir(root, recursive=True)
        name = low = high = out = None
        rows = 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name = f"records-{uuid.uuid4().hex[:12]}-{job}.txt"
                    out, low = fs.open_output_stream(f"{root}/{name}"), r["apn"]
                high, rows = r["apn"], rows + 1
                out.write(f"{json.dumps(r['apn'])}\t{json.dumps([r['owner'], r['address'], r['ring'] and [(p['x'], p['y']) for p in r['ring']]])}\n".encode())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "low": [low], "high": [high], "rows": pa.array([rows], pa.int64())})

    ordered = records.filter("apn is not null").repartitionByRange(files, "apn").sortWithinPartitions("apn")
    # a row for each file: as many as were asked for
    ranges = [r.asDict() for r in ordered.mapInArrow(write, "name string, low string, high string, rows long").collect()]
    fs, root = files_of(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
        f.write(json.dumps(sorted(ranges, key=lambda r: r["low"])).encode())


@dataclass
class Range(InputPartition):
    """One file, as a part of the scan."""

    name: str


@dataclass
class Asked:
    """What pushed filters say about the number."""

    numbers: set | None = None
    low: str | None = None
    high: str | None = None
    open_low: bool = False
    open_high: bool = False

    def among(self, values: Iterable) -> None:
        self.numbers = set(values) if self.numbers is None else self.numbers & set(values)

    def above(self, value: str, open_: bool) -> None:
        if self.low is None or value > self.low or value == self.low and open_:
            self.low, self.open_low = value, open_

    def below(self, value: str, open_: bool) -> None:
        if self.high is None or value < self.high or value == self.high and open_:
            self.high, self.open_high = value, open_

    def holds(self, apn: str) -> bool:
        inside = (self.low is None or apn > self.low or apn == self.low and not self.open_low) and (self.high is None or apn < self.high or apn == self.high and not self.open_high)
        return inside and (self.numbers is None or apn in self.numbers)

    def meets(self, low: str, high: str) -> bool:
        if self.low is not None and high < self.low or self.high is not None and low > self.high:
            return False
        return self.numbers is None or any(low <= n <= high for n in self.numbers)


class RecordReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.asked = path, Asked()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            own = getattr(f, "attribute", None) == ("apn",)
            if own and isinstance(f, EqualTo):
                self.asked.among([f.value])
            elif own and isinstance(f, In):
                self.asked.among(v for v in f.value if v is not None)
            elif own and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.asked.above(f.value, isinstance(f, GreaterThan))
            elif own and isinstance(f, (LessThan, LessThanOrEqual)):
                self.asked.below(f.value, isinstance(f, LessThan))
            elif not (own and isinstance(f, IsNotNull)):  # no record lacks a number
                yield f

    def partitions(self) -> list[Range]:
        fs, root = files_of(self.path)
        with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
            ranges = json.loads(f.read())
        return [Range(r["name"]) for r in ranges if self.asked.meets(r["low"], r["high"])]

    def read(self, partition: Range) -> Iterator[tuple]:
        import io

        fs, root = files_of(self.path)
        with fs.open_input_stream(f"{root}/{partition.name}") as f:
            for line in io.TextIOWrapper(f, encoding="utf-8", newline="\n"):
                number, _, rest = line.partition("\t")
                apn = json.loads(number)
                if self.asked.high is not None and apn > self.asked.high:
                    return  # numbers ascend
                if self.asked.holds(apn):
                    owner, address, ring = json.loads(rest)
                    yield apn, owner, address, ring and [{"x": x, "y": y} for x, y in ring]


class CountyRecords(DataSource):
    """``spark.read.format("county_records").load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "county_records"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self.options["path"])


def county_records(spark: SparkSession, path: str, numbers: list[str] | None = None, most: int = 1000) -> DataFrame:
    """Records below ``path``; of ``numbers`` only, ``most`` of them at once (for more, join the records)."""
    if numbers is not None and len(numbers) > most:
        raise ValueError(f"{len(numbers)} numbers asked for; more than {most} are to be joined")
    spark.dataSource.register(CountyRecords)
    spark.conf.set(PUSHDOWN, "true")
    rows = spark.read.format("county_records").load(path)
    return rows if numbers is None else rows.filter(F.col("apn").isin([n for n in numbers if n is not None]))


# parcel files


@dataclass
class Staged(WriterCommitMessage):
    """Files of one task, and where each belongs."""

    moves: list[tuple[str, str]] = field(default_factory=list)
    rows: int = 0


class _Sink:
    """One document's file, written row by row; ``suffixes`` are the files it leaves."""

    suffixes: tuple[str, ...] = ()

    def __init__(self, fs: pafs.FileSystem, stem: str, schema: StructType, prj: str):
        self.fs, self.stem, self.prj, self.n = fs, stem, prj, 0
        self.columns = [(f.name, isinstance(f.dataType, NumericType)) for f in schema.fields if f.name not in ("document_id", "ring")]
        self.start()

    def values(self, row) -> dict:
        return {name: row[name] for name, _ in self.columns}


class _GeoJson(_Sink):
    suffixes = ("geojson",)

    def start(self) -> None:
        self.out = self.fs.open_output_stream(f"{self.stem}.geojson")
        self.out.write(b'{"type":"FeatureCollection","features":[')

    def add(self, row, ring) -> None:
        closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
        feature = {"type": "Feature", "properties": self.values(row), "geometry": {"type": "Polygon", "coordinates": [closed]}}
        self.out.write((b"," if self.n else b"") + json.dumps(feature, default=str).encode())
        self.n += 1

    def close(self) -> None:
        self.out.write(b"]}")
        self.out.close()


class _Kml(_Sink):
    suffixes = ("kml",)

    def start(self) -> None:
        self.out = self.fs.open_output_stream(f"{self.stem}.kml")
        self.out.write(b'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>')

    def add(self, row, ring) -> None:
        at = " ".join(f"{x:.9f},{y:.9f},0" for x, y in ring)
        colour = KML_COLOURS[self.n % len(KML_COLOURS)]
        self.out.write(f"<Placemark><name>{escape(str(self.values(row).get('label') or ''))}</name><Style><LineStyle><color>{colour}</color></LineStyle></Style><Polygon><outerBoundaryIs><LinearRing><coordinates>{at}</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>".encode())
        self.n += 1

    def close(self) -> None:
        self.out.write(b"</Document></kml>")
        self.out.close()


class _Shapefile(_Sink):
    """Heads need counts and extents, so the records go to body files first, and the files are put together at the end, a block at a time."""

    suffixes = ("shp", "shx", "dbf", "prj", "cpg")

    def start(self) -> None:
        self.bodies = {s: self.fs.open_output_stream(f"{self.stem}.{s}.body") for s in ("shp", "shx", "dbf")}
        self.at, self.extent = 50, None

    def add(self, row, ring) -> None:
        import struct

        self.n += 1
        record, box = shapes.polygon(self.n, ring)
        self.extent = shapes.joined(self.extent, box)
        self.bodies["shp"].write(record)
        self.bodies["shx"].write(struct.pack(">2i", self.at, len(record) // 2 - 4))
        self.at += len(record) // 2
        self.bodies["dbf"].write(shapes.table_row(list(self.values(row).values()), self.columns))

    def close(self) -> None:
        heads = {"shp": shapes.header(self.at, self.extent), "shx": shapes.header(50 + 4 * self.n, self.extent), "dbf": shapes.table_header(self.n, self.columns)}
        for s, body in self.bodies.items():
            body.close()
            with self.fs.open_output_stream(f"{self.stem}.{s}") as out, self.fs.open_input_stream(f"{self.stem}.{s}.body") as source:
                out.write(heads[s])
                while block := source.read(1 << 20):
                    out.write(block)
                out.write(b"\x1a" if s == "dbf" else b"")
            self.fs.delete_file(f"{self.stem}.{s}.body")
        for s, text in (("prj", self.prj), ("cpg", "UTF-8")):
            with self.fs.open_output_stream(f"{self.stem}.{s}") as out:
                out.write(text.encode())


SINKS = {"geojson": _GeoJson, "kml": _Kml, "shapefile": _Shapefile}


class ParcelWriter(DataSourceWriter):
    def __init__(self, path: str, kind: str, schema: StructType, overwrite: bool, prj: str):
        self.path, self.kind, self.schema, self.overwrite, self.prj = path.rstrip("/"), kind, schema, overwrite, prj
        self.job = uuid.uuid4().hex[:12]

    @property
    def staging(self) -> str:
        return f"{files_of(self.path)[1]}/_staged-{self.job}"

    def write(self, iterator: Iterator) -> Staged:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        fs, root = files_of(self.path)
        folder = f"{self.staging}/{part}-{attempt}"
        fs.create_dir(folder, recursive=True)
        done, sink, current, count = Staged(), None, None, 0

        def finish() -> None:
            if sink is not None:
                sink.close()
                for s in sink.suffixes:
                    done.moves.append((f"{sink.stem}.{s}", f"{root}/document_id={current}/part-{part:05d}-{count:05d}-{self.job}.{s}"))

        for row in iterator:
            ring = [(float(p["x"]), float(p["y"])) for p in row["ring"] or []]
            if len(ring) < 3:
                continue
            document = "none" if row["document_id"] is None else "".join(c if c.isalnum() or c in "-_." else f"%{ord(c):02X}" for c in str(row["document_id"]))
            if sink is None or document != current:
                finish()
                count += 1
                sink, current = SINKS[self.kind](fs, f"{folder}/{count:05d}", self.schema, self.prj), document
            sink.add(row, ring)
            done.rows += 1
        finish()
        return done

    def commit(self, messages: list) -> None:
        fs, root = files_of(self.path)
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if old.base_name.startswith("document_id="):
                    fs.delete_dir(old.path)
        for m in messages:
            for source, target in m.moves if m is not None else ():
                fs.create_dir(target.rpartition("/")[0], recursive=True)
                fs.move(source, target)
        self._clear(fs)

    def abort(self, messages: list) -> None:
        self._clear(files_of(self.path)[0])

    def _clear(self, fs: pafs.FileSystem) -> None:
        if fs.get_file_info(self.staging).type != pafs.FileType.NotFound:
            fs.delete_dir(self.staging)


class ParcelFiles(DataSource):
    """``df.write.format("parcel_files").option("kind", ...).save(path)``"""

    @classmethod
    def name(cls) -> str:
        return "parcel_files"

    def writer(self, schema: StructType, overwrite: bool) -> ParcelWriter:
        kind = self.options.get("kind", "geojson")
        if kind not in SINKS or not {"document_id", "ring"} <= set(schema.names):
            raise ValueError(f"kind must be one of {', '.join(SINKS)}, and rows need document_id and ring")
        return ParcelWriter(self.options["path"], kind, schema, overwrite, self.options.get("prj", ""))


def save_parcels(report: DataFrame, path: str, kind: str, prj: str = "", mode: str = "append", parts: int | None = None) -> None:
    """Write parcels (document_id, id, ring and attributes) as one file a document, or several where a document's rows are dealt to ``parts`` tasks."""
    spark = report.sparkSession
    spark.dataSource.register(ParcelFiles)
    keys = ["document_id"] if parts is None else ["document_id", F.pmod(F.xxhash64("id"), F.lit(parts))]
    rows = report.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions("document_id", "id")
    rows.write.format("parcel_files").option("kind", kind).option("prj", prj).mode(mode).save(path)
