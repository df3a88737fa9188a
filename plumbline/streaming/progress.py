"""Progress, rate limits and sessions: batch forms over event tables and their Structured Streaming twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The stages of a run, in order.
STAGES = ("upload", "inspect", "render", "detect", "triage", "roster", "ocr", "vision", "complete")


def current_progress(events: DataFrame, key: str = "document_id") -> DataFrame:
    """Last stage, error and ordered history of each run; an unknown stage is an error of its own."""
    order = F.struct("ts", "stage")
    known = events.withColumn("bad", F.col("stage").isNotNull() & ~F.col("stage").isin(*STAGES))
    return known.groupBy(key).agg(F.max_by("stage", order).alias("stage"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("ts"))).alias("error"), F.sort_array(F.collect_list(F.struct("ts", "stage", "detail"))).alias("history"), F.bool_or("bad").alias("unknown_stage"))


def _seconds(ts: str) -> Column:
    return F.col(ts).cast("timestamp").cast("double")


def _windowed(events: DataFrame, keys: list[str], ts: str, seconds: int, spans: int = 16) -> tuple[DataFrame, Window]:
    """Events dealt by stretches of time, so that a key with many events fills many tasks, and a window over the last ``seconds``.

    A stretch is ``spans`` windows long; events of its last window are copied to the next (``_own`` false), as history only.
    """
    long = F.lit(float(max(1, seconds) * spans))
    at = events.withColumn("_t", _seconds(ts)).withColumn("_stretch", F.floor(F.col("_t") / long))
    late = F.col("_t") + seconds >= (F.col("_stretch") + 1) * long
    at = at.withColumn("_to", F.explode(F.when(late, F.array(F.col("_stretch"), F.col("_stretch") + 1)).otherwise(F.array("_stretch"))))
    at = at.withColumn("_own", F.col("_stretch").eqNullSafe(F.col("_to")))
    return at, Window.partitionBy(*keys, "_to").orderBy("_t").rangeBetween(-seconds, 0)


_HELP = ("_t", "_stretch", "_to", "_own")


def rate_window(events: DataFrame, keys: list[str], ts: str, seconds: int, limit: int) -> DataFrame:
    """Requests of the last ``seconds`` up to and with each event, and whether it is within the limit; the edge counts as inside."""
    e, w = _windowed(events, keys, ts, seconds)
    return e.withColumn("in_window", F.count(F.lit(1)).over(w)).filter("_own").drop(*_HELP).withColumn("allowed", F.col("in_window") <= limit)


def token_window(events: DataFrame, keys: list[str], ts: str, tokens: str, seconds: int, budget: int) -> DataFrame:
    """Tokens of the last ``seconds``; one oversized call alone is admitted."""
    e, w = _windowed(events, keys, ts, seconds)
    e = e.withColumns({"tokens_in_window": F.sum(tokens).over(w), "_n": F.count(F.lit(1)).over(w)}).filter("_own").drop(*_HELP)
    return e.withColumn("allowed", (F.col("tokens_in_window") <= budget) | (F.col("_n") == 1)).drop("_n")


def sessions(events: DataFrame, keys: list[str], ts: str, gap_seconds: int) -> DataFrame:
    """Numbered sessions: a gap of more than ``gap_seconds`` begins another."""
    w = Window.partitionBy(*keys).orderBy(ts, "event_id")
    new = F.coalesce(_seconds(ts) - F.lag(_seconds(ts)).over(w) > gap_seconds, F.lit(True)).cast("int")
    e = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy(*keys, "session").agg(F.count(F.lit(1)).alias("events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def throttled_touches(events: DataFrame, keys: list[str], ts: str, apart: int = 60) -> DataFrame:
    """Activity marks: an event within ``apart`` seconds of the one before changes nothing."""
    w = Window.partitionBy(*keys).orderBy(ts, "event_id")
    return events.withColumn("_gap", _seconds(ts) - F.lag(_seconds(ts)).over(w)).filter(F.col("_gap").isNull() | (F.col("_gap") >= apart)).drop("_gap")


def idle(last_seen: DataFrame, now: Column, ttl_seconds: int = 21_600) -> DataFrame:
    """Rows (last_ts) that have been idle for longer than the limit."""
    return last_seen.filter(now.cast("timestamp").cast("double") - _seconds("last_ts") > ttl_seconds)


def fresh(started: Column, now: Column, seconds: int) -> Column:
    return now.cast("timestamp").cast("double") - started.cast("timestamp").cast("double") < seconds


def orphans(pending: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """Pending work that no live registry entry stands for."""
    return pending.join(registry, keys, "left_anti")


# streams

def stream_counts(events: DataFrame, ts: str, key: str, window: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window, late events up to the watermark."""
    e = events.withWatermark(ts, late)
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return e.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def stream_sessions(events: DataFrame, ts: str, key: str, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "events")


def stream_progress(events: DataFrame, key: str = "document_id") -> DataFrame:
    """Last stage and number of updates of each run, as keyed state that survives restarts."""

    def update(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ts, stage, n = state.get if state.exists else (pd.Timestamp(0), "", 0)
        for pdf in batches:
            for t, s in sorted(zip(pdf["ts"], pdf["stage"])):
                n += 1
                if (t, s) >= (ts, stage):
                    ts, stage = t, s
        state.update((ts, stage, n))
        yield pd.DataFrame({key: [k[0]], "ts": [ts], "stage": [stage], "updates": [n]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, ts timestamp, stage string, updates long", "ts timestamp, stage string, updates long", "update", "NoTimeout")
