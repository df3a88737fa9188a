"""Golden records: one surviving record for each cluster of client rows.

Rows are dealt by cluster and sorted within each partition by RECENT; ``mapInPandas`` streams them.  The first row of a
cluster reveals its latest time, so each row is known to be fresh or stale as it passes.  All that is kept of an open cluster is the rows
that win a rule so far (and its first row, which bears the counts): a handful, whatever the cluster's size.  They are put in front of the
next batch, as they precede it in RECENT, and judged again with it; so a rule is a rank for each row, least first, and of equal ranks the
first row wins.

Hot clusters hold more rows than a quarter of a partition has on the average (and ``HOT`` at least): there are at most four for each
partition, so their sizes, latest times and chosen values of ``like`` rules, from aggregates that combine before the shuffle, can be broadcast.  Their
rows are cut into pieces by hash, about as many as make a piece as long as the winners of all pieces, and streamed alike; a piece's
winners take its rows' place in the second stream, with its counts.

Orders: RECENT is latest time (null last), higher trust, smaller id, and for rows alike in these the remaining values (nulls last).
TRUSTED is fresh before stale, higher trust, then RECENT; sources without a rank come last.  A row is stale if its time is null or more
than ``STALE`` before its cluster's latest.

Nulls: strings that are empty or blank count as null in all rules.  Rows whose cluster is null form one record.  A value that no row has is
null, and so is the id it is from; NaN is a value, without cents.  Repeated rows count as often as they stand.  Further columns are ignored.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, load, partitions

STALE = 30 * 24 * 3600 * 1_000_000  # microseconds
HOT = 64
SOURCES = ("partner", "store", "web", "crm")
NEVER = -(2**63)
BLANK = r"\A[\x20\x09-\x0D]*\z"


@dataclass(frozen=True)
class Rule:
    """How ``columns`` survive, together.

    by: ``recent`` and ``trusted`` take the first row in that order that has a value, ``longest`` the one of most code points (then
    TRUSTED), ``fullest`` the one with most values among the columns (then TRUSTED).  like: rows that have the chosen value of
    that column's rule come before all others.
    """

    name: str
    columns: tuple[str, ...]
    by: str
    like: str | None = None


RULES = (
    Rule("segment", ("segment",), "recent"),
    Rule("name", ("name",), "longest"),
    Rule("email", ("email",), "trusted"),
    Rule("balance", ("balance",), "recent", like="segment"),
    Rule("address", ("city", "nation_id"), "fullest"),
)


def micros(at: Column, kind: str) -> Column:
    """Microseconds of a time; those without a zone are read as they stand, whatever the session's zone is."""
    if kind != "timestamp_ntz":
        return F.unix_micros(at.cast("timestamp"))
    since = at - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda what: F.extract(F.lit(what), since)
    seconds = (part("DAY").cast("long") * 24 + part("HOUR")) * 3600 + part("MINUTE") * 60
    return seconds * 1_000_000 + (part("SECOND") * 1_000_000).cast("long")


def prepared(rows: DataFrame, rules: tuple[Rule, ...], cluster: Column, id_: str, at: str, source: str, sources: tuple[str, ...]) -> DataFrame:
    """What the streams read: key, at (``NEVER`` if null), trust, id, a string for each column of a rule, n, and n_stale (not known yet)."""
    kinds = dict(rows.dtypes)
    trust = F.lit(len(sources))
    for k, s in reversed(list(enumerate(sources))):
        trust = F.when(F.col(source) == s, k).otherwise(trust)
    value = lambda c: F.when(~F.col(c).rlike(BLANK), F.col(c)) if kinds[c] == "string" else F.col(c).cast("string")
    columns = dict.fromkeys(c for r in rules for c in r.columns)
    return rows.select(
        cluster.cast("string").alias("key"),
        F.coalesce(micros(F.col(at), kinds[at]), F.lit(NEVER)).alias("at"),
        trust.cast("int").alias("trust"),
        F.col(id_).alias("order"),
        F.col(id_).cast("string").alias("id"),
        *(value(c).alias(f"v_{c}") for c in columns),
        F.lit(1).cast("long").alias("n"),
        F.lit(-1).cast("long").alias("n_stale"),
    )


class Judge:
    """Winners of each cluster in a frame that is sorted by key and RECENT."""

    def __init__(self, rules: tuple[Rule, ...], levels: int, stale: int):
        self.rules, self.levels, self.stale = sorted(rules, key=lambda r: r.like is not None), levels, stale

    def __call__(self, rows: pd.DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Starts of the clusters; for each rule the row that wins (-1: none has a value); rows and stale rows of each cluster."""
        key = rows["key"].to_numpy(object)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        cluster = np.repeat(np.arange(len(starts)), sizes)
        at = rows["at"].to_numpy(np.int64)
        latest = at[starts] if "latest" not in rows else rows["latest"].to_numpy(np.int64)[starts]
        stale = (at == NEVER) | (at < latest[cluster] - self.stale)
        order = stale * self.levels + rows["trust"].to_numpy(np.int64)
        n, known = rows["n"].to_numpy(np.int64), rows["n_stale"].to_numpy(np.int64)
        n_stale = np.add.reduceat(np.where(known < 0, stale, known), starts)
        out, chosen = {}, {}
        for rule in self.rules:
            values = [rows[f"v_{c}"].to_numpy(object) for c in rule.columns]
            filled = sum(pd.notna(v).astype(np.int64) for v in values)
            rank = np.zeros(len(key), np.int64) if rule.by == "recent" else order
            if rule.by == "longest":
                rank = rank - 2 * self.levels * np.fromiter((len(v) if isinstance(v, str) else 0 for v in values[0]), np.int64, len(key))
            if rule.by == "fullest":
                rank = rank - 2 * self.levels * filled
            if rule.like:
                wanted = chosen[rule.like][cluster]
                rank = np.where(pd.notna(wanted) & (rows[f"v_{rule.like}"].to_numpy(object) == wanted), -1, rank)
            eligible = (filled > 0) | (rule.by == "fullest")
            rank = np.where(eligible, rank, np.iinfo(np.int64).max)
            best = np.minimum.reduceat(rank, starts)
            first = np.where((rank == best[cluster]) & eligible, np.arange(len(key)), len(key))
            won = np.minimum.reduceat(first, starts)
            out[rule.name] = np.where(won < len(key), won, -1)
            found = np.full(len(starts), None, object)
            found[won < len(key)] = values[0][won[won < len(key)]]
            given = f"given_{rule.name}"
            chosen[rule.name] = rows[given].to_numpy(object)[starts] if given in rows else found
        return starts, out, np.add.reduceat(n, starts), n_stale

    def winners(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The rows that win a rule, and the first of each cluster, which has the counts of all."""
        starts, out, n, n_stale = self(rows)
        kept = np.unique(np.concatenate([starts, *out.values()]))
        kept = kept[kept >= 0]
        left = rows.iloc[kept].copy()
        first = np.isin(kept, starts)
        left["n"] = np.where(first, np.repeat(n, np.diff(np.r_[np.flatnonzero(first), len(kept)])), 0)
        left["n_stale"] = np.where(first, np.repeat(n_stale, np.diff(np.r_[np.flatnonzero(first), len(kept)])), 0)
        return left

    def records(self, rows: pd.DataFrame) -> pd.DataFrame:
        """One row for each cluster."""
        starts, out, n, n_stale = self(rows)
        made = {"key": rows["key"].to_numpy(object)[starts], "n_records": n, "n_stale": n_stale}
        id_ = rows["id"].to_numpy(object)
        for rule in self.rules:
            won = out[rule.name]
            has = np.zeros(len(starts), bool)
            for c in rule.columns:
                value = np.where(won >= 0, rows[f"v_{c}"].to_numpy(object)[won], None)
                made[f"v_{c}"] = value
                has |= pd.notna(value)
            made[f"{rule.name}_from"] = np.where(has, id_[won], None)
        return pd.DataFrame(made)


def streamed(frames: Iterator[pd.DataFrame], judge: Judge, emit) -> Iterator[pd.DataFrame]:
    """``emit`` of all clusters of a sorted stream; of the one still open only its winners are kept."""
    open_: pd.DataFrame | None = None
    for rows in frames:
        if not len(rows):
            continue
        rows = rows if open_ is None else pd.concat([open_, rows], ignore_index=True)
        key = rows["key"].to_numpy(object)
        last = len(key) - int((key[::-1] == key[-1]).cumprod().sum())
        if last:
            yield emit(rows.iloc[:last].reset_index(drop=True))
        open_ = judge.winners(rows.iloc[last:].reset_index(drop=True)).reset_index(drop=True)
    if open_ is not None:
        yield emit(open_)


def golden_records(
    rows: DataFrame,
    cluster: Column,
    rules: tuple[Rule, ...] = RULES,
    id_: str = "client_id",
    at: str = "updated_at",
    source: str = "source",
    sources: tuple[str, ...] = SOURCES,
    stale: int = STALE,
    least_hot: int = HOT,
) -> DataFrame:
    """One row for each cluster: key, n_records, n_stale, the columns of all rules, and for each rule NAME_from, an ``id_``.

    Key, values and ids have the types of ``rows``.  A table of at most four rows a partition is written and broadcast.
    """
    spark, kinds = rows.sparkSession, {f.name: f.dataType for f in rows.schema.fields}
    columns = list(dict.fromkeys(c for r in rules for c in r.columns))
    ready = prepared(rows, rules, cluster, id_, at, source, sources)
    recent = ["key", F.col("at").desc(), "trust", F.col("order").asc_nulls_last(), *(F.col(f"v_{c}").asc_nulls_last() for c in columns)]
    judge = Judge(rules, len(sources) + 1, stale)
    total, parts = rows.count(), partitions(spark)

    # clusters above their share: sizes first, then what their pieces need to know of each other
    sizes = cut(ready.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > max(least_hot, total // (4 * parts))), "sizes")
    named = sizes.select(F.col("key").alias("hot"), "size")
    of_hot = ready.join(F.broadcast(named), F.col("key").eqNullSafe(F.col("hot")))
    place = F.struct((-F.greatest(F.col("at"), F.lit(NEVER + 1))).alias("a"), "trust", F.col("order").isNull().alias("none"), "order", *(x for c in columns for x in (F.col(f"v_{c}").isNull().alias(f"none_{c}"), f"v_{c}")))
    liked = [r for r in rules if any(x.like == r.name for x in rules)]
    if any(r.by != "recent" for r in liked):
        raise ValueError("a rule can only follow one that goes by recent")
    given = [F.min_by(f"v_{r.columns[0]}", F.when(F.col(f"v_{r.columns[0]}").isNotNull(), place)).alias(f"given_{r.name}") for r in liked]
    facts = cut(of_hot.groupBy("hot").agg(F.max("size").alias("size"), F.max("at").alias("latest"), *given), "facts")
    facts = facts.withColumn("pieces", F.ceil(F.sqrt(F.col("size") / (len(rules) + 1))).cast("long"))

    layout = ready.schema
    piece = F.pmod(F.xxhash64("id", "at", *(f"v_{c}" for c in columns)), F.col("pieces"))
    pieces = ready.join(F.broadcast(facts), F.col("key").eqNullSafe(F.col("hot"))).withColumn("piece", piece).drop("hot", "size", "pieces")
    dealt = pieces.repartition(parts, "key", "piece").sortWithinPartitions(*recent)

    def reduce(frames):
        # rows of a cluster that meet in a partition are one piece
        for made in streamed(frames, judge, judge.winners):
            yield made[layout.names]

    reduced = dealt.mapInPandas(reduce, layout)
    plain = ready.join(F.broadcast(named), F.col("key").eqNullSafe(F.col("hot")), "left_anti")
    # both streams' rows in one exchange
    whole = plain.unionByName(reduced).repartition(parts, "key").sortWithinPartitions(*recent)
    made = ["key string", "n_records long", "n_stale long"]
    for r in judge.rules:
        made += [*(f"v_{c} string" for c in r.columns), f"{r.name}_from string"]
    out = whole.mapInPandas(lambda frames: streamed(frames, judge, judge.records), ", ".join(made))
    return out.select(
        F.col("key").cast(rows.select(cluster).schema[0].dataType).alias("key"),
        "n_records",
        "n_stale",
        *(F.col(f"v_{c}").cast(kinds[c]).alias(c) for c in columns),
        *(F.col(f"{r.name}_from").cast(kinds[id_]) for r in rules),
    )


def cents(x: Column) -> Column:
    """floor(100 x + 0.5); null where that is no 64-bit number."""
    scaled = F.floor(x * 100 + F.lit(0.5))
    return F.when(~F.isnan(x) & (F.abs(x) < 9e16), scaled.cast("long"))


def op12_golden_records(spark, sf_dir: str) -> DataFrame:
    """One record for each cluster (master_id, if null client_id) of ``clients``."""
    records = golden_records(load(spark, sf_dir, "clients"), F.coalesce("master_id", "client_id"))
    return records.select(
        F.col("key").alias("cluster_id"),
        "n_records",
        "n_stale",
        "name",
        "email",
        "segment",
        "city",
        "nation_id",
        cents(F.col("balance")).alias("balance_cents"),
        "name_from",
        "email_from",
        "segment_from",
        "balance_from",
        "address_from",
    )


def _first(value: str, order: str, has: str) -> str:
    return f"first({value} ORDER BY {order}) FILTER ({has})"


_RECENT = "updated_at DESC NULLS LAST, trust, client_id NULLS LAST, segment NULLS LAST, name NULLS LAST, email NULLS LAST, balance NULLS LAST, city NULLS LAST, nation_id NULLS LAST"
_TRUSTED = f"stale, trust, {_RECENT}"
OP12_SQL = rf"""
WITH c AS (
  SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at, balance, nation_id,
    {", ".join(f"CASE WHEN NOT regexp_full_match({c}, '[{chr(92)}x20{chr(92)}x09-{chr(92)}x0D]*') THEN {c} END AS {c}" for c in ("name", "email", "city", "segment"))},
    coalesce(CASE source {" ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(SOURCES))} END, {len(SOURCES)}) AS trust
  FROM clients
), s AS (
  SELECT *, updated_at IS NULL OR updated_at < max(updated_at) OVER w - INTERVAL 720 HOUR AS stale,
    first_value(segment) OVER (PARTITION BY cluster_id ORDER BY segment IS NULL, {_RECENT}) AS chosen,
    (city IS NOT NULL)::INT + (nation_id IS NOT NULL)::INT AS filled
  FROM c WINDOW w AS (PARTITION BY cluster_id)
)
SELECT cluster_id, count(*) AS n_records, count(*) FILTER (stale) AS n_stale,
  {_first("name", f"length(name) DESC, {_TRUSTED}", "name IS NOT NULL")} AS name,
  {_first("email", _TRUSTED, "email IS NOT NULL")} AS email,
  {_first("segment", _RECENT, "segment IS NOT NULL")} AS segment,
  {_first("city", f"filled DESC, {_TRUSTED}", "true")} AS city,
  {_first("nation_id", f"filled DESC, {_TRUSTED}", "true")} AS nation_id,
  TRY_CAST(floor(100 * {_first("balance", f"CASE WHEN segment = chosen THEN 0 ELSE 1 END, {_RECENT}", "balance IS NOT NULL")} + 0.5) AS BIGINT) AS balance_cents,
  {_first("client_id", f"length(name) DESC, {_TRUSTED}", "name IS NOT NULL")} AS name_from,
  {_first("client_id", _TRUSTED, "email IS NOT NULL")} AS email_from,
  {_first("client_id", _RECENT, "segment IS NOT NULL")} AS segment_from,
  {_first("client_id", f"CASE WHEN segment = chosen THEN 0 ELSE 1 END, {_RECENT}", "balance IS NOT NULL")} AS balance_from,
  CASE WHEN max(filled) > 0 THEN {_first("client_id", f"filled DESC, {_TRUSTED}", "true")} END AS address_from
FROM s GROUP BY cluster_id
"""
