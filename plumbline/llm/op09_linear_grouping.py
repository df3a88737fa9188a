"""Packing token sequences by linear grouping and configurations.

All planning happens on the histogram of lengths (at most ``capacity`` numbers), however many documents there
are.  Pieces longer than ``capacity // SMALL`` are large: sorted by length they form ``GROUPS`` groups of equal
cardinality, each rounded up to its longest member.  A linear program over configurations of the few rounded
sizes (columns found by a knapsack) is optimised and rounded down; what is left is filled greedily.  Then actual
lengths take the rounded slots, and small pieces go best-fit into the remaining space, run by run: equal
sequences are one *class* with a multiplicity, so the plan is a list of runs "the pieces of length L with ranks
r0..r1 stand at offset o of sequences s.." whose number is bounded by the number of lengths and configurations.

Nulls: a null text is empty (its piece is the end id alone).  Repeated rows are packed like any other.  A null
doc_id is kept.  Texts longer than ``capacity`` ids are cut, nothing is dropped.  An empty table gives an empty
result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, load, partitions, slices
from .vocab import coder, vocabulary_path

VOCABULARY, CAPACITY, END_ID = "word_bpe_49k.json", 4096, 1
GROUPS, SMALL = 96, 16


def groups_of(hist: np.ndarray, least: int, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(rounded size, runs of (length, count) from long to short) of each group of equal cardinality."""
    lengths = [int(x) for x in np.flatnonzero(hist) if x > least][::-1]
    total = int(hist[lengths].sum()) if lengths else 0
    if not total:
        return []
    if len(lengths) <= groups:
        return [(x, [(x, int(hist[x]))]) for x in lengths]
    per, out, room = -(-total // groups), [], 0
    for x in lengths:
        n = int(hist[x])
        while n:
            if not room:
                out.append((x, []))
                room = per
            take = min(n, room)
            out[-1][1].append((x, take))
            n, room = n - take, room - take
    merged: list[tuple[int, list[tuple[int, int]]]] = []
    for size, runs in out:  # one very frequent length can fill several groups
        if merged and merged[-1][0] == size:
            merged[-1][1].extend(runs)
        else:
            merged.append((size, list(runs)))
    return merged


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable configuration: how many of each size."""
    best, picks = np.zeros(capacity + 1), []
    for i, (s, v) in enumerate(zip(sizes.tolist(), values.tolist())):
        if v <= 1e-12:
            continue
        left, k = capacity // s, 1
        while left > 0:
            k = min(k, left)
            w = s * k
            with_it = best[: capacity + 1 - w] + v * k
            better = np.zeros(capacity + 1, bool)
            better[w:] = with_it > best[w:] + 1e-12
            best[w:] = np.maximum(best[w:], with_it)
            picks.append((i, k, w, better))
            left, k = left - k, k * 2
    a, c = np.zeros(len(sizes), np.int64), int(np.argmax(best))
    top = float(best[c])
    for i, k, w, better in reversed(picks):
        if better[c]:
            a[i] += k
            c -= w
    return top, a


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """(configuration, multiplicity) that meet the demand: linear program, rounded down, rest filled greedily."""
    s, n = np.array(sizes), np.array(demand, float)
    basis = np.diag(capacity // s).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x, y = inverse @ n, inverse.sum(axis=0)
        top, column = _knapsack(s, y, capacity)
        if top <= 1 + 1e-9 or x.sum() - (y @ n) / top < 0.5:
            break
        way = inverse @ column
        ok = way > 1e-9
        ratio = np.full(len(x), np.inf)
        ratio[ok] = np.maximum(x[ok], 0) / way[ok]
        basis[:, int(np.argmin(ratio))] = column
    x = np.linalg.solve(basis, n)
    left, out = np.array(demand, np.int64), []
    for a, times in sorted(((basis[:, j].astype(np.int64), x[j]) for j in range(len(s))), key=lambda p: -p[1]):
        m = min(int(times + 1e-6), int((left[a > 0] // a[a > 0]).min()))
        if m > 0:
            out.append((a, m))
            left = left - m * a
    while left.any():
        a, room = np.zeros(len(s), np.int64), capacity
        for i in np.argsort(-s, kind="stable"):
            k = min(int(left[i]), room // int(s[i]))
            a[i], room = k, room - k * int(s[i])
        m = int((left[a > 0] // a[a > 0]).min())
        out.append((a, m))
        left = left - m * a
    return out


class _Plan:
    """Classes of equal sequences: [multiplicity, space left, items], an item being (length, rank of its first piece)."""

    def __init__(self, capacity: int):
        self.capacity, self.rank, self.done = capacity, {}, []
        self.by_space: dict[int, list] = {}

    def take(self, length: int, n: int) -> int:
        r = self.rank.get(length, 0)
        self.rank[length] = r + n
        return r

    @staticmethod
    def split(cls: list, m: int) -> tuple[list, list | None]:
        """The first ``m`` sequences of a class, and the others."""
        if m == cls[0]:
            return cls, None
        return [m, cls[1], cls[2]], [cls[0] - m, cls[1], [(x, r + m) for x, r in cls[2]]]

    def put(self, cls: list) -> None:
        self.by_space.setdefault(cls[1], []).append(cls)

    def add(self, cls: list, length: int) -> None:
        self.put([cls[0], cls[1] - length, [*cls[2], (length, self.take(length, cls[0]))]])


def plan(hist: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, end rank, first sequence, offset) for a histogram of lengths, and the number of sequences."""
    p, least = _Plan(capacity), capacity // small
    hist = hist.copy()
    if hist[capacity]:
        p.put([int(hist[capacity]), 0, [(capacity, p.take(capacity, int(hist[capacity])))]])
        hist[capacity] = 0
    if kinds := groups_of(hist, least, groups):
        runs = [list(r) for _, r in kinds]  # each group's actual lengths, from long to short
        for a, m in configurations([k for k, _ in kinds], [sum(c for _, c in r) for _, r in kinds], capacity):
            open_classes = [[m, capacity, []]]
            for i in np.flatnonzero(a):
                for _ in range(int(a[i])):
                    filled = []
                    while open_classes:
                        cls = open_classes.pop(0)
                        length, count = runs[i][0]
                        cls, rest = p.split(cls, min(cls[0], count))
                        if rest:
                            open_classes.insert(0, rest)
                        runs[i][0] = (length, count - cls[0])
                        if count == cls[0]:
                            runs[i].pop(0)
                        filled.append([cls[0], cls[1] - length, [*cls[2], (length, p.take(length, cls[0]))]])
                    open_classes = filled
            for cls in open_classes:
                p.put(cls)
    for length in range(least, 0, -1):
        n = int(hist[length])
        while n:
            space = min((s for s in p.by_space if s >= length), default=None)
            if space is None:
                fit = capacity // length
                full, rest = divmod(n, fit)
                for times, k in ((full, fit), (1, rest)):
                    if times and k:
                        p.put([times, capacity - k * length, [(length, p.take(length, times)) for _ in range(k)]])
                break
            cls = p.by_space[space].pop()
            if not p.by_space[space]:
                del p.by_space[space]
            cls, rest = p.split(cls, min(n, cls[0]))
            if rest:
                p.put(rest)
            p.add(cls, length)
            n -= cls[0]
    out, sequence = [], 0
    for classes in p.by_space.values():
        for m, _, items in classes:
            offset = 0
            for length, rank in items:
                out.append((length, rank, rank + m, sequence, offset))
                offset += length
            sequence += m
    return np.array(sorted(out), np.int64).reshape(-1, 5), sequence


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every row of ``docs`` (doc_id, text)."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def write(batches):
        code = coder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, lens = code.ids(part.column("text").fill_null("").to_pylist(), end_id)
                pieces = -(-lens // capacity)
                row = np.repeat(np.arange(len(lens)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, lens[row] - start)
                at = (np.cumsum(lens) - lens)[row] + start
                raw = memoryview(ids.astype("<u4")).cast("B")
                crcs = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
                columns = [part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
                if keep_ids:  # pieces follow each other, as their ids do
                    columns.append(pa.ListArray.from_arrays(np.r_[0, np.cumsum(length)].astype(np.int32), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * keep_ids)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(write, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, salt: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (with doc_id, piece, length) and the sequence_id and offset of each.  ``pieces`` must give the same rows each time it is read.

    ``salt``: columns whose hash spreads pieces of one length; rows that are alike in all of them meet in one task.
    """
    hist = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        hist[r["length"]] = r["count"]
    runs, _ = plan(hist, capacity, groups)
    keys = (runs[:, 0] << 40) | runs[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, (length.to_numpy() << 40) | rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": runs[at, 3] + rank.to_numpy() - runs[at, 1], "offset": runs[at, 4]})

    # ranks of equal lengths, numbered in buckets so that a frequent length is spread over many tasks
    salted = pieces.withColumn("_b", F.pmod(F.xxhash64(*salt), F.lit(partitions(pieces.sparkSession))))
    before = salted.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("length", "_b", (F.sum("_n").over(Window.partitionBy("length").orderBy("_b")) - F.col("_n")).alias("_before"))
    ranked = salted.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "_b"])
    placed = ranked.withColumn("_p", place("length", F.col("_before") + F.col("_r")))
    return placed.select(*pieces.columns, "_p.sequence_id", "_p.offset")


def op9_linear_grouping(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids."""
    return pack_documents(load(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    # written beside the pieces, the partition they come from tells copies of one row, and rows without an id, apart
    pieces = cut(cut_pieces(docs, vocabulary_path(VOCABULARY), CAPACITY, END_ID).withColumn("dealt", F.spark_partition_id()), "pieces")
    return pack(pieces, salt=("doc_id", "piece", "ids_crc32", "dealt")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
