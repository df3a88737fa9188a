"""Token ids as length-delimited binary records with masked checksums and a separate offset index.

A record is: payload length (u64), masked checksum of those 8 bytes (u32), payload, masked checksum of the
payload (u32), all little-endian.  The payload is doc_id (i64), id width in bytes (u32: 2 where the vocabulary
fits, else 4), number of ids (u32), ids.  Next to ``NAME.rec`` lies ``NAME.idx``: doc_id (i64), offset (u64),
length of the whole record (u64), number of ids (u32) for each record, so that any record can be fetched alone.
Files hold ascending ranges of doc_id, of equal ones by the text's hash and then the partition they come from; a file ends at ``ROLL`` bytes, so
neither a file nor what a task holds of its index grows with the part.  The checksum is CRC-32 rotated right by 15 bits plus 0xA282EAD8.

Both files of a part bear the name of the task attempt that wrote them, and the table of parts, which only holds rows of
attempts that Spark commits, names them.  A lost executor or a second attempt leaves files that nothing refers to.

Nulls: a null text is empty (its record holds the end id only); a null doc_id is stored as the smallest 64-bit
integer and read back as null.  Repeated rows give repeated records.  An empty table gives no records.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, load, partitions, scratch, shared_files, slices
from .vocab import coder, vocabulary_path

NONE = -(2**63)
HEAD = struct.Struct("<qII")
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("n", "<u4")])
VOCABULARY, END_ID = "word_bpe_49k.json", 2
ROLL, AT_ONCE = 256 << 20, 2000  # bytes of a file's records; records whose digests are handed on together


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(record: bytes) -> bytes:
    """The payload of one whole record; raises if a length or a checksum doesn't hold."""
    (n,), (a,) = struct.unpack_from("<Q", record), struct.unpack_from("<I", record, 8)
    if masked(record[:8]) != a or len(record) != n + 16:
        raise ValueError("damaged record length")
    payload = record[12 : 12 + n]
    if masked(payload) != struct.unpack_from("<I", record, 12 + n)[0]:
        raise ValueError("damaged record payload")
    return payload


class _Files:
    """The pair of files that a task is writing: records, and the index beside them as it grows."""

    def __init__(self, fs, root: str, name: str):
        self.name, self.at, self.records, self.ids, self.entries = name, 0, 0, 0, []
        self.out, self.index = (fs.open_output_stream(f"{root}/{name}.{kind}") for kind in ("rec", "idx"))

    def add(self, doc: int, own: np.ndarray) -> None:
        record = frame(_payload(doc, own))
        self.out.write(record)
        self.entries.append((doc, self.at, len(record), len(own)))
        self.at, self.records, self.ids = self.at + len(record), self.records + 1, self.ids + len(own)
        if len(self.entries) == AT_ONCE:
            self._flush()

    def _flush(self) -> None:
        self.index.write(np.array(self.entries, INDEX).tobytes())
        self.entries = []

    def close(self, part: int, place: int) -> pa.RecordBatch:
        self._flush()
        self.out.close()
        self.index.close()
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "place": pa.array([place], pa.int32()), "name": pa.array([self.name]), "records": pa.array([self.records], pa.int64()), "ids": pa.array([self.ids], pa.int64())})


def write_records(docs: DataFrame, path: str, vocabulary: str, end_id: int | None, roll: int = ROLL) -> DataFrame:
    """Write ``docs`` (doc_id, text) below ``path``; returns a row for each pair of files: part, place (within it), name, records, ids.  Eager."""
    spark = docs.sparkSession

    def write(batches):
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs, root = shared_files(path)
        fs.create_dir(root, recursive=True)
        code, files, place = coder(vocabulary), None, 0
        width = np.uint16 if code.tok.get_vocab_size() <= 65_536 else np.uint32
        for batch in batches:
            for piece in slices(batch, "text"):
                ids, lens = code.ids(piece.column("text").fill_null("").to_pylist(), end_id)
                ids, bounds = ids.astype(width), np.r_[0, np.cumsum(lens)].tolist()
                for k, doc in enumerate(piece.column("doc_id").to_pylist()):
                    if files is None:
                        files = _Files(fs, root, f"part-{part:06d}-{place:06d}-{attempt}")
                    files.add(NONE if doc is None else doc, ids[bounds[k] : bounds[k + 1]])
                    if files.at >= roll:
                        yield files.close(part, place)
                        files, place = None, place + 1
        if files is not None:
            yield files.close(part, place)

    tie, dealt = F.xxhash64(F.coalesce("text", F.lit(""))), F.spark_partition_id()
    keys = ["doc_id", "tie", "dealt"]  # the last one lets rows that are alike lie in several files
    ranged = docs.select("doc_id", "text", tie.alias("tie"), dealt.alias("dealt")).repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    return cut(ranged.mapInArrow(write, "part int, place int, name string, records long, ids long"), "parts")


def read_index(path: str, name: str) -> np.ndarray:
    fs, root = shared_files(path)
    with fs.open_input_stream(f"{root}/{name}.idx") as f:
        return np.frombuffer(f.read(), INDEX)


def fetch(path: str, name: str, entry) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of one indexed record, by a seek."""
    fs, root = shared_files(path)
    with fs.open_input_file(f"{root}/{name}.rec") as f:
        return _parse(unframe(f.read_at(int(entry["length"]), int(entry["offset"]))))


def _payload(doc: int, ids: np.ndarray) -> bytes:
    return HEAD.pack(doc, ids.itemsize, len(ids)) + ids.tobytes()


def _parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc, width, n = HEAD.unpack_from(payload)
    ids = np.frombuffer(payload, f"<u{width}", n, HEAD.size)
    return (None if doc == NONE else doc), ids.astype("<u4")


def read_records(parts: DataFrame, path: str) -> DataFrame:
    """doc_id, part, name (of the file), place (in it), n_tokens, ids of every record, read back from the files by their index."""

    def read(batches):
        for batch in batches:
            for part, name in zip(batch.column("part").to_pylist(), batch.column("name").to_pylist()):
                fs, root = shared_files(path)
                index = read_index(path, name)
                with fs.open_input_stream(f"{root}/{name}.rec") as f:
                    for k in range(0, len(index), 1000):
                        docs, ids = zip(*(_parse(unframe(f.read(int(e["length"])))) for e in index[k : k + 1000]))
                        lens = [len(i) for i in ids]
                        values = pa.array(np.concatenate(ids).astype(np.int32))
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "part": pa.array([part] * len(docs), pa.int32()), "name": pa.array([name] * len(docs)), "place": pa.array(range(k, k + len(docs)), pa.int64()), "n_tokens": pa.array(lens, pa.int64()), "ids": pa.ListArray.from_arrays(np.r_[0, np.cumsum(lens)].astype(np.int32), values)})

    spread = parts.select("part", "name").repartition(partitions(parts.sparkSession), "name")
    return spread.mapInArrow(read, "doc_id long, part int, name string, place long, n_tokens long, ids array<int>")


def digests(parts: DataFrame, path: str) -> DataFrame:
    """doc_id, name (of the file), start_in_file, n_tokens, ids_crc32 of every record, read back from the files."""

    def read(batches):
        for batch in batches:
            for name in batch.column("name").to_pylist():
                fs, root = shared_files(path)
                index = read_index(path, name)
                n = index["n"].astype(np.int64)
                start = np.cumsum(n) - n
                with fs.open_input_stream(f"{root}/{name}.rec", buffer_size=1 << 20) as f:
                    for k in range(0, len(index), AT_ONCE):
                        docs, crcs = [], []
                        for length in index["length"][k : k + AT_ONCE].tolist():
                            doc, ids = _parse(unframe(f.read(length)))
                            docs.append(doc)
                            crcs.append(zlib.crc32(ids.tobytes()))
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "name": pa.array([name] * len(docs)), "start_in_file": pa.array(start[k : k + len(docs)]), "n_tokens": pa.array(n[k : k + len(docs)]), "ids_crc32": pa.array(crcs, pa.int64())})

    spread = parts.select("name").repartition(partitions(parts.sparkSession), "name")
    return spread.mapInArrow(read, "doc_id long, name string, start_in_file long, n_tokens long, ids_crc32 long")


def op8_token_records(spark, sf_dir: str) -> DataFrame:
    """Every document's ids as records in ascending doc_id order, read back from the files."""
    path = scratch(spark, "records")
    parts = write_records(load(spark, sf_dir, "documents"), path, vocabulary_path(VOCABULARY), END_ID)
    # a row for each file, and files are large: the records before each one
    sizes = sorted((r["part"], r["place"], r["name"], r["ids"]) for r in parts.collect())
    starts = np.cumsum([0] + [n for *_, n in sizes])[:-1].tolist()
    before = spark.createDataFrame([(name, s) for (_, _, name, _), s in zip(sizes, starts)], "name string, before long")
    out = digests(parts, path).join(F.broadcast(before), "name")
    return out.select("doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")
