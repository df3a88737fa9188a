"""Token counts through a digest cache.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens).  Content is normalised (null becomes
empty; nothing else, as any other change could alter a count) and digested by SHA-256; the tokenizer version is
the SHA-256 of its vocabulary file.  Texts are reduced to distinct digests before they are moved (a hot text costs a row a task);
those whose pair of digests is not stored are encoded once each and appended; the counts of all rows then come from the cache by a join.  Digests that a ``1 /
HOT`` share of all rows have (``HOT`` at most) are joined where their rows are, as the join would deal them to one task.

Nulls: a null text is empty and counts 0.  Repeated rows stay repeated.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, load, scratch, slices
from .vocab import coder, vocabulary_path

VOCABULARY, LIMIT, HOT = "byte_bpe_50k.json", 1024, 1000
CACHE = "content_digest binary, tokenizer_digest string, n_tokens long"
_EXCLUDED = "spark.sql.optimizer.excludedRules"
#: Spark would look up every row's digest, and move every copy of a hot text for that, before it drops copies.
_EARLY = "org.apache.spark.sql.catalyst.optimizer.PushDownLeftSemiAntiJoin"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _appended(spark, cache: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)  # nothing was ever appended


def _stored(spark, cache: str, tokenizer: str, only: DataFrame | None = None) -> DataFrame:
    """Counts of the cache for one tokenizer, of all digests or of ``only`` a few (broadcast)."""
    rows = _appended(spark, cache)
    if only is not None:
        rows = rows.join(F.broadcast(only), "content_digest", "left_semi")
    # a run that was repeated after a loss may have appended a count twice: counts of equal digests are equal
    return rows.filter(F.col("tokenizer_digest") == tokenizer).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def _seen(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content_digest"), F.octet_length(text).cast("long").alias("n_bytes"))


def remember(docs: DataFrame, cache: str, vocabulary: str, most_bytes: int = 4 << 20) -> None:
    """Encode the distinct texts of ``docs`` (doc_id, text) whose counts ``cache`` lacks, and append them."""
    spark, version, seen = docs.sparkSession, tokenizer_digest(vocabulary), _seen(docs)

    def encode(batches):
        code = coder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", most_bytes):
                counts = code.counts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("content_digest"), pa.array([version] * part.num_rows), pa.array(counts, pa.int64())], ["content_digest", "tokenizer_digest", "n_tokens"])

    # copies inside a partition go before the shuffle, the rest after it, and what is left is held against the cache where it lies
    distinct = seen.groupBy("content_digest").agg(F.first("text").alias("text"))
    known = _appended(spark, cache).filter(F.col("tokenizer_digest") == version).select("content_digest")
    misses = distinct.join(known, "content_digest", "left_anti")
    before = spark.conf.get(_EXCLUDED, None)
    spark.conf.set(_EXCLUDED, ",".join(x for x in (before, _EARLY) if x))
    try:
        misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
    finally:
        spark.conf.set(_EXCLUDED, before) if before else spark.conf.unset(_EXCLUDED)


def count_tokens(docs: DataFrame, cache: str, vocabulary: str, most_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, content_digest, n_bytes, n_tokens of every row of ``docs`` (doc_id, text).  Appends to ``cache``."""
    spark, version, seen = docs.sparkSession, tokenizer_digest(vocabulary), _seen(docs)
    remember(docs, cache, vocabulary, most_bytes)

    rows = cut(seen.drop("text"), "digests")
    sizes = rows.groupBy("content_digest").count().filter(F.col("count") >= max(HOT, rows.count() // HOT)).select("content_digest")
    hot = cut(_stored(spark, cache, version, sizes), "hot")  # HOT rows at most
    there = rows.join(F.broadcast(hot), "content_digest")
    others = rows.join(F.broadcast(hot.select("content_digest")), "content_digest", "left_anti")
    return there.unionByName(others.join(_stored(spark, cache, version), "content_digest"))


def op2_digest_cache(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents for ``byte_bpe_50k.json``; an earlier run has left the counts of English ones in the cache."""
    docs, cache, vocabulary = load(spark, sf_dir, "documents"), scratch(spark, "token-cache"), vocabulary_path(VOCABULARY)
    remember(docs.filter(F.col("lang") == "en"), cache, vocabulary)
    counts = count_tokens(docs, cache, vocabulary)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
