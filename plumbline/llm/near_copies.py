"""Operator 7 for near copies by word shingles: multi-index hashing first, complete similarities verified, and what balls miss.

Texts are alike if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more; a group is what links
connect, and one row of each group stays.  Shingles are 64-bit hashes (XXH64); texts of equal sets are one node.

1. Fingerprints of the shingles go through the multi-index of ``op07_simhash``; links within its radius are verified by
   exact similarity.  That joins the closest copies of large groups, but a radius that misses no similarity of 0.8
   (8 to 10 of 64 bits on the average) has balls as large as the tables.
2. So the rest is found exactly.  All shingles have one order, rare ones first.  Of two texts of similarity s or more that have
   n shingles, both hold one of the first n - ceil(s n) + 1 of each other, so only these are filed, in a bucket for each
   shingle.  In a bucket of over ``CROWD`` texts all are compared with a few pivots only.  Of texts that meet there, those are
   verified that sizes, positions and maps do not rule out: a map has about a bit for each shingle, and two sets differ in at least
   as many shingles as their maps in bits.  So most that only share a passage never have their sets written.
3. Texts of a crowded bucket that pivots and fingerprints have not brought into one group meet again there: with all texts of the
   bucket's other groups.  So pairs of one large group are never written out, and no link between two groups is lost.
4. To verify a pair is to bring two sets of six bytes a shingle together.  Each text is compared with one other first; of all other
   pairs only those go on that lie in different groups then.  They are verified by parts of a bounded number of shingles.

Which shingles come last, which buckets are dealt in pieces and which texts are pivots matters for speed only.

Nulls: a null text has no shingles, like all texts without words; these are alike.  Texts of up to five words are one
shingle.  Rows with a null doc_id are rows like others, and come last when a group's row is chosen: the smallest doc_id, then
the text's hash, then the row's.  Of rows that are equal in all columns one stays.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, fresh, partitions, slices, texts_of
from .components import components
from .op07_simhash import folded, links, shingle_hashes

WORDS, SIMILARITY, SEED = 5, 0.8, 42
SAMPLE, OFTEN = 20_000, 5  # texts whose shingles are counted, and the count from which one comes last
CROWD, PIVOTS, PIECE = 48, 6, 100_000  # texts that meet pair by pair; pivots of larger buckets; texts of a bucket's piece, about
SIEVE_BITS, MAP_BITS = 26, 1024
PART = 2_000_000  # shingles that are brought together at once, at least; else a quarter of all
_EPS = 1e-9


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles of UTF-8 bytes; words as in ``op07_simhash.shingle_hashes``."""
    return np.unique(shingle_hashes(text, words, SEED).view(np.int64))


def prefix_size(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - _EPS) + 1


# rows


def keyed(docs: DataFrame) -> DataFrame:
    """lacks (an id), doc, tie, pick and text: what tells rows apart, in the order of preference."""
    columns = [c for c, kind in docs.dtypes if not kind.startswith("map")]
    return docs.select(
        F.col("doc_id").isNull().alias("lacks"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), F.xxhash64(*columns).alias("pick"), "text",
    )


KEY = ["lacks", "doc", "tie", "pick"]


def _marked(rows: DataFrame, words: int) -> DataFrame:
    """KEY, node (digest of the shingle set), fp, n (size of the set), map and wide (a wider map of a larger set) of every row."""

    def write(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                nodes, fps, sizes, maps, wide = [], [], [], [], []
                for t in texts_of(part.column("text")):
                    h = shingle_hashes(t, words, SEED)
                    s = np.unique(h.view(np.int64))
                    nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                    fps.append(folded(h) if len(h) else 0)
                    sizes.append(len(s))
                    maps.append(_map(s))
                    wide.append(_map(s, 1 << (len(s) - 1).bit_length()) if len(s) > MAP_BITS else None)
                numbers = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in KEY), *numbers, pa.array(sizes, pa.int32()), pa.array(maps, pa.binary()), pa.array(wide, pa.binary())], [*KEY, "node", "fp", "n", "map", "wide"])

    return rows.mapInArrow(write, "lacks boolean, doc long, tie long, pick long, node long, fp long, n int, map binary, wide binary")


# a sieve: rows that may be among many keys, without a shuffle of the others


def sieve(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of one hash for ``keys`` (h), of fixed size: 8 MB however many they are."""
    bit = F.col("h").bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
    words = keys.select(F.shiftright(bit, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    out[np.asarray(words.column("w"), dtype=np.int64)] = np.asarray(words.column("b"), dtype=np.int64).view(np.uint64)
    return out


def sifted(rows: DataFrame, column: str, bits, through: bool) -> DataFrame:
    """Rows whose hash ``column`` may be in the sieve (a broadcast), or those that surely are not."""

    def sift(batches):
        for batch in batches:
            h = np.asarray(batch.column(batch.schema.get_field_index(column)), dtype=np.int64) & ((1 << SIEVE_BITS) - 1)
            held = (bits.value[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) == 1
            yield batch.filter(pa.array(held if through else ~held))

    return rows.mapInArrow(sift, rows.schema)


# buckets


def _common(rows: DataFrame, words: int, every: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that the sample holds OFTEN or more, ascending, with their counts."""

    def write(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(t, words) for t in texts_of(part.column("text"))]
                token, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.int64),) * 2
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n.astype(np.int64))], ["token", "n"])

    counts = rows.filter(F.pmod(F.xxhash64("tie"), F.lit(every)) == 0).select("text").mapInArrow(write, "token long, n long")
    found = counts.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN).toArrow()
    token, n = (np.asarray(found.column(c), dtype=np.int64) for c in ("token", "n"))
    order = np.argsort(token)
    return token[order], n[order]


_FILED = "token long, piece int, node long, n int, pos int"


def _prefixes(rows: DataFrame, words: int, similarity: float, total: int) -> DataFrame:
    """token, piece, node, n (size of the set) and pos (place of the token in the order) of every filed shingle.

    A bucket that the sample shows to be hot is dealt in pieces; of others piece is -1.  A node is filed once a batch.
    """
    every = max(1, total // SAMPLE)
    shared = rows.sparkSession.sparkContext.broadcast(_common(rows, words, every))

    def write(batches):
        common, count = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                out, seen = [], set()
                for text in texts_of(part.column("text")):
                    s = shingle_set(text, words)
                    node = xxhash.xxh64_intdigest(s.tobytes(), SEED)
                    if not len(s) or node in seen:
                        continue
                    seen.add(node)
                    rank = np.zeros(len(s), np.int64)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        rank = np.where(common[at] == s, count[at], 0)
                    k = prefix_size(len(s), similarity)
                    first = np.lexsort((s, rank))[:k]
                    pieces = -(-rank[first] * every // PIECE)
                    out.append((s[first], np.where(pieces > 1, (np.uint64(node) % np.maximum(pieces, 1).astype(np.uint64)).astype(np.int64), -1), np.full(k, node, np.uint64).view(np.int64), np.full(k, len(s)), np.arange(k)))
                if out:
                    yield from _batches([np.concatenate(c) for c in zip(*out)], _FILED)

    return rows.select("text").mapInArrow(write, _FILED)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def _batches(columns, schema: str):
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    for a in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000] if isinstance(c, np.ndarray) else c.slice(a, 100_000), _KINDS[k]) for c, k in zip(columns, kinds)], list(names))


def _possible(n, pos, a, b, similarity: float) -> np.ndarray:
    """Whether sets of these sizes that first share a shingle at these places can be alike."""
    small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    most = np.minimum(n[a] - pos[a], n[b] - pos[b])
    return (small >= similarity * large - _EPS) & (most * (1 + similarity) >= similarity * (n[a] + n[b]) - _EPS)


def meets(bucket: np.ndarray, n: np.ndarray, pos: np.ndarray, similarity: float):
    """Places (a, b) of rows of one bucket that may be alike, by blocks.  Rows are sorted by bucket and n."""
    at, step = np.arange(len(bucket)), 1
    while len(at := at[at + step < len(bucket)]):
        # sets of one bucket grow: where the next is too large, all later ones are
        at = at[(bucket[at] == bucket[at + step]) & (n[at] >= similarity * n[at + step] - _EPS)]
        ok = _possible(n, pos, at, at + step, similarity)
        yield at[ok], at[ok] + step
        step += 1


def _whole(batches, keys: int, rows: int = 200_000):
    """Columns of batches that are sorted by the first ``keys`` columns, regrouped so that none is cut within a key."""
    held, have, need = [], 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)])
        have += batch.num_rows
        if have < need:
            continue
        now = [np.concatenate(x) for x in zip(*held)]
        last = np.logical_and.reduce([c == c[-1] for c in now[:keys]])
        end = len(last) if not last[:-1].any() and not last.any() else int(np.argmax(last))
        if end:
            yield [c[:end] for c in now]
        held, have = [[c[end:] for c in now]], have - end
        need = rows if end else 2 * have
    if have:
        yield [np.concatenate(x) for x in zip(*held)]


_MET = "a long, b long, token long, n int, pos int"


def _first_meeting(filed: DataFrame, similarity: float, crowd: int) -> DataFrame:
    """Pairs (a, b) that may be alike, and rows of crowded buckets (node as a, b null)."""

    def fetch(batches):
        for token, piece, node, n, pos in _whole(batches, 2):
            new = np.r_[True, (token[1:] != token[:-1]) | (piece[1:] != piece[:-1]) | (node[1:] != node[:-1])]
            token, piece, node, n, pos = (c[new] for c in (token, piece, node, n, pos))
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            head = np.r_[True, (token[1:] != token[:-1]) | (piece[1:] != piece[:-1])]
            start, bucket = np.flatnonzero(head), np.cumsum(head) - 1
            size = np.diff(np.r_[start, len(token)])
            crowded = (size > crowd)[bucket]
            calm = np.flatnonzero(~crowded)
            for a, b in meets(bucket[calm], n[calm], pos[calm], similarity):
                yield from _pairs(node[calm[a]], node[calm[b]])
            big = np.flatnonzero(size > crowd)
            for k in range(PIVOTS):
                pivot = start[big] + ((2 * k + 1) * size[big]) // (2 * PIVOTS)
                a = np.flatnonzero(crowded)
                b = np.repeat(pivot, size[big])
                ok = (a != b) & _possible(n, pos, a, b, similarity)
                yield from _pairs(node[a[ok]], node[b[ok]])
            open_ = np.flatnonzero(crowded | (piece >= 0))
            if len(open_):
                yield from _batches([node[open_], pa.nulls(len(open_), pa.int64()), token[open_], n[open_], pos[open_]], _MET)

    n = partitions(filed.sparkSession)
    ranged = filed.repartition(n, "token", "piece").sortWithinPartitions("token", "piece", "n", "node")
    return ranged.mapInArrow(fetch, _MET)


def _pairs(x: np.ndarray, y: np.ndarray):
    none = lambda k: pa.nulls(len(x), k)
    if len(x):
        yield from _batches([np.minimum(x, y), np.maximum(x, y), none(pa.int64()), none(pa.int32()), none(pa.int32())], _MET)


def _second_meeting(rows: DataFrame, groups: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of crowded buckets (token, node, n, pos) whose texts may be alike and lie in different groups (node, root).

    Rows of a bucket's largest group are dealt to pieces of bounded size, the others are copied to each piece.  Maps (of ``nodes``)
    rule out pairs whose sets surely differ in too many shingles.
    """
    at = rows.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = cut(at.dropDuplicates(["token", "node"]), "open")
    sizes = open_.groupBy("token", "root").agg(F.count(F.lit(1)).alias("rows"))
    largest = cut(sizes.groupBy("token").agg(F.max_by("root", F.struct("rows", "root")).alias("largest"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("groups")).filter("groups > 1"), "largest")
    pieces, main = F.ceil(F.col("rows") / PIECE).cast("int"), F.col("root") == F.col("largest")
    at = open_.join(largest.select("token", "largest", pieces.alias("pieces")), "token").join(nodes.select("node", "map"), "node")
    at = at.select("token", "n", "node", "pos", "root", "map", main.alias("main"), "pieces", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int").alias("own"))
    at = at.withColumn("piece", F.explode(F.when(F.col("main"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("pieces") - 1))))
    at = at.select("token", "piece", "n", "node", "pos", "root", "main", (F.col("piece") == F.col("own")).alias("home"), "map")

    def fetch(batches):
        for token, piece, n, node, pos, root, main, home, maps in _whole(batches, 2):
            head = np.r_[True, (token[1:] != token[:-1]) | (piece[1:] != piece[:-1])]
            n, pos, maps = n.astype(np.int64), pos.astype(np.int64), np.frombuffer(b"".join(maps), np.uint64).reshape(len(n), -1)
            place = (np.cumsum(head) - 1) * np.int64(1 << 40)  # rows in the order of buckets and sizes
            other = np.flatnonzero(~main)
            low = np.searchsorted(place + n, place[other] + np.ceil(similarity * n[other] - _EPS).astype(np.int64))
            high = np.searchsorted(place + n, place[other] + np.floor(n[other] / similarity + _EPS).astype(np.int64), "right")
            ends = np.cumsum(high - low)
            k = 0
            while k < len(other):  # blocks of so many meetings: two maps are held for each
                stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + 100_000, "right")))
                m = (high - low)[k:stop]
                a = np.repeat(other[k:stop], m)
                b = np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[k:stop], m)
                ok = (root[a] != root[b]) & (home[a] | home[b]) & (main[b] | (b > a)) & _possible(n, pos, a, b, similarity)
                a, b = a[ok], b[ok]
                apart = np.bitwise_count(maps[a] ^ maps[b]).sum(1, dtype=np.int64)
                ok = apart <= _most_apart(n[a] + n[b], similarity)
                yield from _pairs(node[a[ok]], node[b[ok]])
                k = stop

    n = partitions(rows.sparkSession)
    met = at.repartition(n, "token", "piece").sortWithinPartitions("token", "piece", "n", "node").mapInArrow(fetch, _MET)
    out = cut(met.select("a", "b").distinct(), "late")
    drop(open_, largest)
    return out


# verification


def _packed(s: np.ndarray) -> bytes:
    """48 bits of each hash, ascending."""
    return np.sort(s.view(np.uint64) >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _map(s: np.ndarray, width: int = MAP_BITS) -> bytes:
    """For each lowest part of a hash whether an odd number of shingles has it: two sets differ in at least as many shingles as their maps differ in bits."""
    return np.packbits(np.bincount((s.view(np.uint64) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1 != 0).tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """Bits in which maps differ; of two widths the wider one is folded, as if it had been made of the other's width."""
    a, b = (np.frombuffer(m, np.uint64) for m in (x, y))
    if len(a) != len(b):
        a, b = (np.bitwise_xor.reduce(m.reshape(-1, min(len(a), len(b))), 0) for m in (a, b))
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def _most_apart(both, similarity: float):
    """In how many shingles sets that are alike may differ, by the sum of their sizes."""
    return both * (1 - similarity) / (1 + similarity) + _EPS


def _likely(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) that sizes and maps of ``nodes`` do not rule out, with n, the size of a's set.  Eager."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.coalesce("wide", "map").alias(f"m{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - _EPS)

    def compare(batches):
        for batch in batches:
            n, m, x, y = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("na", "nb", "ma", "mb"))
            keep = [_apart(p, q) <= _most_apart(i + j, similarity) for i, j, p, q in zip(n, m, x, y)]
            yield batch.select(["a", "b", "na"]).rename_columns(["a", "b", "n"]).filter(pa.array(keep, pa.bool_()))

    return cut(both.mapInArrow(compare, "a long, b long, n int"), "likely")


def _sets(rows: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and packed set of the ``wanted`` nodes, from one row of each (``nodes`` has its key as ``first``).  Eager."""
    spark = rows.sparkSession
    key = F.xxhash64("doc", "tie")
    of = cut(nodes.join(wanted, "node", "left_semi").select("node", "first.doc", "first.tie", key.alias("h")), "wanted")
    bits = spark.sparkContext.broadcast(sieve(of.select(F.xxhash64("doc", "tie").alias("h"))))
    texts = sifted(rows.select("doc", "tie", "text", key.alias("h")), "h", bits, True).dropDuplicates(["doc", "tie"])

    def write(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = [_packed(shingle_set(t, words)) for t in texts_of(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.binary())], ["node", "s"])

    out = cut(texts.join(of.select("node", "doc", "tie"), ["doc", "tie"]).select("node", "text").mapInArrow(write, "node long, s binary"), "sets")
    drop(of)
    bits.unpersist()
    return out


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are alike.  Eager."""
    node = F.xxhash64("node")
    bits = pairs.sparkSession.sparkContext.broadcast(sieve(_ends(pairs).select(node.alias("h"))))
    sets = sifted(sets.select("node", "s", node.alias("h")), "h", bits, True).select("node", "s")
    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")

    def compare(batches):
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)) for c in ("sa", "sb"))
            keep = []
            for x, y in zip(a, b):
                x, y = _unpacked(x.as_buffer()), _unpacked(y.as_buffer())
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared > 0 and shared >= similarity * (len(x) + len(y) - shared) - _EPS)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = cut(both.mapInArrow(compare, "a long, b long"), "alike")
    bits.unpersist()
    return out


def _by_parts(pairs: DataFrame, sets: DataFrame, similarity: float, most: int) -> list[DataFrame]:
    """``_verified`` of ``pairs`` (a, b, n) in parts by b, so that about ``most`` shingles of a are brought together at once."""
    parts = max(1, -(-(pairs.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0) // most))
    return [_verified(pairs.filter(F.pmod(F.xxhash64("b"), F.lit(parts)) == k), sets, similarity) for k in range(parts)]


def _alike(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, words: int, similarity: float, most: int) -> list[DataFrame]:
    """Links (a, b) that connect what those of ``pairs`` (a, b, n) connect whose sets are alike.  Eager.

    Every text is compared with its smallest partner first; pairs that lie in one group then are not looked at.
    """
    sets = _sets(rows, nodes, _ends(pairs).distinct(), words)
    first = cut(pairs.groupBy("b").agg(F.min(F.struct("a", "n")).alias("least")).select("least.a", "b", "least.n"), "first")
    found = _by_parts(first, sets, similarity, most)
    roots = cut(components(_all(found)), "roots")
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    apart = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    rest = cut(apart.join(first, ["a", "b"], "left_anti").select("a", "b", "n"), "rest")
    found += _by_parts(rest, sets, similarity, most)
    drop(sets, first, roots, rest)
    return found


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


# groups


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """KEY, node and stays (whether it is its group's) of every row of ``docs`` (doc_id, text and others).  Eager."""
    rows, total = keyed(docs), docs.count()
    marked = cut(_marked(rows, words), "marked")
    nodes = cut(marked.groupBy("node").agg(F.min(F.struct(*KEY)).alias("first"), *(F.first(c).alias(c) for c in ("fp", "n", "map", "wide"))), "nodes")
    most = max(PART, (nodes.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0) // 4)

    met = cut(_first_meeting(_prefixes(rows, words, similarity, total), similarity, crowd), "met")
    of_fp = cut(nodes.groupBy("fp").agg(F.min("node").alias("node")), "of_fp")
    linked = cut(links(of_fp), "close")
    close = linked.join(of_fp.select(F.col("fp").alias("a"), F.col("node").alias("na")), "a").join(of_fp.select(F.col("fp").alias("b"), F.col("node").alias("nb")), "b")
    close = close.select("na", "nb").unionByName(nodes.join(of_fp.select("fp", F.col("node").alias("na")), "fp").filter("node <> na").select("na", F.col("node").alias("nb")))
    pairs = close.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).unionByName(met.filter("b is not null").select("a", "b")).distinct()
    pairs = cut(pairs, "pairs")
    drop(of_fp, linked)

    likely = _likely(pairs, nodes, similarity)
    drop(pairs)
    found = _alike(likely, rows, nodes, words, similarity, most)
    drop(likely)
    open_ = met.filter("b is null").select(F.col("a").alias("node"), "token", "n", "pos")
    roots = cut(components(_all(found)), "roots")
    late = _second_meeting(open_, roots, nodes, similarity)
    drop(met, roots)
    likely = _likely(late, nodes, similarity)
    drop(late)
    found += _alike(likely, rows, nodes, words, similarity, most)
    drop(likely)
    roots = cut(nodes.select("node", "first").join(components(_all(found)), "node"), "roots")
    drop(*found)

    least = cut(roots.groupBy("root").agg(F.min("first").alias("stays")), "least")
    grouped = roots.join(least, "root").select("node", "stays")
    of = cut(grouped.unionByName(nodes.join(roots.select("node"), "node", "left_anti").select("node", F.col("first").alias("stays"))), "of")
    drop(least, roots, nodes)
    return marked.join(of, "node").select(*KEY, "node", "stays")


def without_near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group.

    Only rows that go, or that repeat a key, are joined with what is decided about them; all others pass where they are.
    """
    spark = docs.sparkSession
    found = near_copies(docs, words, similarity)
    kept = found.groupBy(*KEY).agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("rows"))
    decided = cut(kept.select(*KEY, (F.struct(*KEY) == F.col("stays")).alias("keep"), "rows").filter("not keep or rows > 1"), "decided")
    drop(found)
    h, keys = fresh(docs.columns, "h"), {c: fresh(docs.columns, c) for c in KEY}
    bits = spark.sparkContext.broadcast(sieve(decided.select(F.xxhash64("tie", "pick").alias("h"))))
    marks = {keys["lacks"]: F.col("doc_id").isNull(), keys["doc"]: F.coalesce("doc_id", F.lit(0)).cast("long"), keys["tie"]: F.xxhash64(F.coalesce("text", F.lit("")))}
    columns = [c for c, kind in docs.dtypes if not kind.startswith("map")]
    marked = docs.withColumns(marks | {keys["pick"]: F.xxhash64(*columns)}).withColumn(h, F.xxhash64(keys["tie"], keys["pick"]))
    sure = sifted(marked, h, bits, False).select(*docs.columns)
    held = sifted(marked, h, bits, True).dropDuplicates(list(keys.values()))
    gone = decided.filter("not keep").select(*(F.col(c).alias(keys[c]) for c in KEY))
    return sure.unionByName(held.join(gone, list(keys.values()), "left_anti").select(*docs.columns))
