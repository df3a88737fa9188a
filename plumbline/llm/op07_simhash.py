"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits: bit i is 1 if it is set in over half of the XXH64 values (seed 42) of the text's 4-word
shingles.  Two fingerprints link if they differ in at most four bits.  Bits are cut into three segments of 22, 21
and 21 bits with a table each.  If two fingerprints link, they differ in at most one bit of segment 0, or at most one of
segment 1, or not at all in segment 2 (else there were 2 + 2 + 1 = 5 differing bits); so each fingerprint is filed
under its own segment values and fetched by the balls of radius 1, 1 and 0 around them.  Of a pair that differs in one bit,
the side that has the bit set looks up the other.  Complete distances are then verified.

Equal fingerprints are one node.  A bucket's links are not written pair by pair: the task that verifies them keeps
one link from every member to the smallest of its group, so that what leaves a bucket is no larger than the bucket.
Buckets of over ``BUCKET`` entries are dealt in pieces: an entry at home is at home in one piece and looks up the others.

Nulls: a null or wordless text has fingerprint zero and links like any other.  A null doc_id gets a fingerprint and
the component of its links; a component of null doc_ids only has a null component_id.  Repeated rows stay.  An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, load, partitions, slices, texts_of
from .components import components, local_components

WORDS, SEED, DISTANCE = 4, 42, 4
FETCH = 200_000  # entries whose buckets are verified at once, unless one bucket has more
BUCKET, SAMPLE = 50_000, 1_000_000  # entries of a bucket's piece, about; fingerprints whose buckets are counted before
#: (lowest bit, width, radius) of each segment.
SEGMENTS = ((0, 22, 1), (22, 21, 1), (43, 21, 0))


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of UTF-8 bytes, repeats included: only A-Z are lower-cased, words end at ASCII white space."""
    parts = text.lower().split()
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)] if parts else [], np.uint64)
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(lens + 1) - lens - 1
    ends = (starts + lens)[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends)), np.uint64, len(ends))


def folded(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes: bits that over half of them have."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 50_000):
        votes += np.unpackbits(hashes[k : k + 50_000].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    return folded(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (64 bits as a signed long) of each row of ``docs`` (doc_id, text)."""

    def write(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                fps = np.array([fingerprint(t) for t in texts_of(part.column("text"))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(write, "doc_id long, fp long")


def _entries(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (table and key), fingerprints and whether the entry is at home, for all tables and balls."""
    u, buckets, owners, homes = fps.view(np.uint64), [], [], []
    for t, (low, width, radius) in enumerate(SEGMENTS):
        key = ((u >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
        buckets.append(t << 40 | key)
        owners.append(fps)
        homes.append(np.ones(len(fps), bool))
        for bit in range(width if radius else 0):
            at = np.flatnonzero(key >> bit & 1)
            buckets.append(t << 40 | (key[at] ^ (1 << bit)))
            owners.append(fps[at])
            homes.append(np.zeros(len(at), bool))
    return np.concatenate(buckets), np.concatenate(owners), np.concatenate(homes)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= DISTANCE


def forest(bucket: np.ndarray, fp: np.ndarray, home: np.ndarray, most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the verified pairs of these whole buckets connect.  Rows are sorted by bucket."""
    nodes, node = np.unique(fp, return_inverse=True)
    order = np.lexsort((~home, bucket))
    bucket, fp, home, node = bucket[order], fp[order], home[order], node[order]
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[first, len(bucket)])
    homes = np.add.reduceat(home.astype(np.int64), first)
    start, count = np.repeat(first, size), np.repeat(homes, size)
    # a row meets the homes of its bucket; of two homes the later one does
    meets = np.where(home, np.arange(len(bucket)) - start, count)
    label, at = np.arange(len(nodes)), 0
    ends = np.cumsum(meets)
    while at < len(bucket):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        n = meets[at:stop]
        left = np.repeat(np.arange(at, stop), n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[at:stop], n)
        ok = _near(fp[left], fp[right])
        a, b = label[node[left[ok]]], label[node[right[ok]]]
        if len(a):
            label = local_components(len(nodes), a, b)[label]
        at = stop
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _pieces(fps: DataFrame, file) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that a sample shows to be hot, ascending, and into how many pieces each is dealt; a fixed share of the sample at most.

    Which ones these are matters for speed only.
    """
    every = max(1, fps.count() // SAMPLE)
    entries = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).mapInArrow(file, "bucket long, fp long, home boolean")
    found = entries.groupBy("bucket").count().filter(F.col("count") >= max(8, BUCKET // every)).toArrow()
    bucket, n = (np.asarray(found.column(c), dtype=np.int64) for c in ("bucket", "count"))
    order = np.argsort(bucket)
    return bucket[order], np.maximum(2, -(-n[order] * every // BUCKET))


def _dealt(bucket: np.ndarray, fp: np.ndarray, home: np.ndarray, hot: np.ndarray, pieces: np.ndarray):
    """Rows with a piece: of a hot bucket each row is at home in one piece at most, and a visitor in all others."""
    piece = np.zeros(len(bucket), np.int32)
    if not len(hot):
        return bucket, piece, fp, home
    at = np.minimum(np.searchsorted(hot, bucket), len(hot) - 1)
    n = np.where(hot[at] == bucket, pieces[at], 1)
    row = np.repeat(np.arange(len(bucket)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    own = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % n
    return bucket[row], piece.astype(np.int32), fp[row], home[row] & (own[row] == piece)


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints of ``fps`` (fp) wherever four bits or fewer differ."""
    spark = fps.sparkSession

    def file(batches):
        for batch in batches:
            bucket, fp, home = _entries(np.asarray(batch.column("fp"), dtype=np.int64))
            for k in range(0, len(bucket), 100_000):
                s = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[s]), pa.array(fp[s]), pa.array(home[s])], ["bucket", "fp", "home"])

    hot = spark.sparkContext.broadcast(_pieces(fps.select("fp"), file))

    def deal(batches):
        for batch in batches:
            bucket, piece, fp, home = _dealt(*_entries(np.asarray(batch.column("fp"), dtype=np.int64)), *hot.value)
            for k in range(0, len(bucket), 100_000):
                s = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[s]), pa.array(piece[s]), pa.array(fp[s]), pa.array(home[s])], ["bucket", "piece", "fp", "home"])

    def fetch(batches):
        held, rows, need = [], 0, FETCH
        for batch in batches:
            held.append([np.asarray(batch.column(0)) << 20 | np.asarray(batch.column(1)), np.asarray(batch.column(2)), batch.column(3).to_numpy(zero_copy_only=False)])
            rows += batch.num_rows
            if rows < need:
                continue
            now = [np.concatenate(x) for x in zip(*held)]
            cut_at = int(np.searchsorted(now[0], now[0][-1]))  # the last bucket may go on
            if cut_at:
                yield _links(*(x[:cut_at] for x in now))
            held, rows = [[x[cut_at:] for x in now]], rows - cut_at
            need = FETCH if cut_at else 2 * rows
        if rows:
            yield _links(*(np.concatenate(x) for x in zip(*held)))

    filed = fps.select("fp").mapInArrow(deal, "bucket long, piece int, fp long, home boolean")
    ranged = filed.repartition(partitions(spark), "bucket", "piece").sortWithinPartitions("bucket", "piece")
    return ranged.mapInArrow(fetch, "a long, b long")


def _links(bucket, fp, home) -> pa.RecordBatch:
    a, b = forest(bucket, fp, home)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs`` (doc_id, text)."""
    marked = cut(fingerprints(docs), "fingerprints")
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    linked = cut(nodes.join(components(links(nodes)).withColumnRenamed("node", "fp"), "fp"), "linked")
    # both sides of the joins below are tables as written, so that a large component or group of copies can be split
    least = cut(linked.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    of = linked.join(least, "root").select("fp", "component_id")
    of = cut(of.unionByName(nodes.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("component_id"))), "of")
    return marked.join(of, "fp")


def op7_multi_index(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
