"""Sharding by a Feistel permutation of global row numbers, with cycle walking.

Row numbers 0..N-1 follow (doc_id, checksum, size).  A balanced Feistel network permutes the smallest power of
four not below N; a value that leaves 0..N-1 is permuted again until it falls inside, which keeps the map a
bijection of 0..N-1.  Position p goes to shard ``p % shards``, slot ``p // shards``: counts differ by one at
most, slots are gapless, and shard and slot of any row number can be computed without the table.

Nulls: a null text counts as empty (size 16, checksum 0); null doc_ids sort first and are placed like any other.
Repeated rows are separate rows with neighbouring numbers.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, load, partitions

SHARDS, SEED, ROUNDS = 40, 20_240_607, 6


def _round_keys(seed: int, rounds: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**32, rounds, dtype=np.uint64)


def permute(numbers: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """Image of each of ``numbers`` (all below ``n``) under the permutation of 0..n-1."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, shift, keys = np.uint64((1 << half) - 1), np.uint64(half), _round_keys(seed, rounds)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(29)) & mask)
        return (left << shift) | right

    out = once(np.asarray(numbers, dtype=np.uint64))
    while (outside := np.flatnonzero(out >= n)).size:
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def number_rows(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with ``row_number`` 0..N-1 in the given order, and N.

    One range shuffle of narrow rows; each range numbers its own rows and is shifted by the rows before it.
    The numbered ranges are written first, so that counts and numbers come from the same ranges.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id()
    ranged = cut(ranged.withColumn("_id", inside), "numbered")
    ranged = ranged.withColumns({"_range": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND((1 << 33) - 1)})
    # one row for each range: as many as there are shuffle partitions, whatever the input
    sizes = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())
    n = sum(c for _, c in sizes)
    starts = np.cumsum([0] + [c for _, c in sizes])[:-1].tolist()
    offsets = spark.createDataFrame([(r, s) for (r, _), s in zip(sizes, starts)], "_range long, _start long")
    out = ranged.join(F.broadcast(offsets), "_range").withColumn("row_number", F.col("_start") + F.col("_place"))
    return out.drop("_id", "_range", "_place", "_start"), n


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, n = number_rows(narrow, ["doc_id", "text_crc32", "size"])

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    numbered = numbered.withColumn("position", place("row_number"))
    return numbered.withColumns({"shard": (F.col("position") % shards).cast("int"), "slot": F.floor(F.col("position") / F.lit(shards)).cast("long")})


def op5_feistel_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the law ``rows``."""
    placed = shard(load(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
