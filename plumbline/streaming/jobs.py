"""Background reads of a document: asked for once, marked while they run, taken up again when their worker is lost.

A job (a page's control points, a confirmation's verification) gets events: ``request``, ``result`` and ``failure``, the last
two with the number of the attempt they come from.  A request starts an attempt unless one is running or the job is done.  An
attempt that has neither ended is stale ``stale`` seconds after its start; the next request starts another.  A result counts if it is the
latest attempt's, even after that went stale, as long as nobody has started again; results of attempts that were
replaced are ignored, failures of them as well.  A job that is done is forgotten after ``forget`` seconds.

``attempts`` is the batch form, ``stream_attempts`` the same over a stream: there events wait in keyed state until the watermark
has passed them, so that the order in which they arrive changes nothing, and timers end attempts whose worker says nothing
any more.  Equal times: results, then failures, then requests, by attempt.  Events without a job, a time or a known kind are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Seconds after which a control-point read and a verification count as lost.
CONTROL_STALE, VERIFY_STALE, FORGET = 480, 900, 86_400
KINDS = ("result", "failure", "request")
OUT = "attempt int, started timestamp, ended timestamp, outcome string"
_STATE = "attempt int, started long, running boolean, done long"


def _known(events: DataFrame, key: str) -> DataFrame:
    """key, at (microseconds), rank of the kind, attempt."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    rows = events.select(F.col(key), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), rank.alias("rank"), F.coalesce("attempt", F.lit(0)).cast("int").alias("attempt"))
    return rows.filter(F.col(key).isNotNull() & F.col("at").isNotNull() & (F.col("rank") > 0))


# batch


def attempts(events: DataFrame, key: str, until: Column, stale: int = CONTROL_STALE, forget: int = FORGET) -> DataFrame:
    """Ended attempts of each job: key and OUT; those still running at ``until`` (a time) are left out.  ``ignored`` rows have no start.

    A fold over the job's events in order, which one row holds: a job has few.
    """
    long, none = (lambda c: c.cast("long")), F.lit(None).cast("long")
    item = "array<struct<attempt:int,started:long,ended:long,outcome:string>>"
    start = F.struct(F.lit(0).alias("attempt"), none.alias("started"), F.lit(False).alias("running"), none.alias("done"), F.array().cast(item).alias("out"))

    def state(attempt, started, running, done, out) -> Column:
        return F.struct(attempt.cast("int").alias("attempt"), long(started).alias("started"), running.alias("running"), long(done).alias("done"), out.alias("out"))

    def row(attempt, started, ended, outcome: str) -> Column:
        return F.array(F.struct(attempt.cast("int").alias("attempt"), long(started).alias("started"), long(ended).alias("ended"), F.lit(outcome).alias("outcome")))

    def expired(s: Column, at: Column) -> Column:
        end = s["started"] + stale * 1_000_000
        gone = s["running"] & (at >= end)
        old = s["done"].isNotNull() & (at >= s["done"] + forget * 1_000_000)
        return state(F.when(old, 0).otherwise(s["attempt"]), s["started"], s["running"] & ~gone, F.when(~old, s["done"]), F.when(gone, F.concat(s["out"], row(s["attempt"], s["started"], end, "stale"))).otherwise(s["out"]))

    def step(before: Column, e: Column) -> Column:
        at = e["at"]

        def seen(s: Column) -> Column:
            mine, undone = (e["attempt"] == s["attempt"]) & (s["attempt"] > 0), s["done"].isNull()
            begins = (e["rank"] == 3) & undone & ~s["running"]
            counts, late = (e["rank"] == 1) & s["running"] & mine, (e["rank"] == 1) & ~s["running"] & undone & mine
            fails = (e["rank"] == 2) & s["running"] & mine
            ended = state(s["attempt"], s["started"], F.lit(False), F.when(counts | late, at), F.concat(s["out"], F.when(counts, row(s["attempt"], s["started"], at, "done")).when(late, row(s["attempt"], s["started"], at, "done late")).otherwise(row(s["attempt"], s["started"], at, "failed"))))
            ignored = state(s["attempt"], s["started"], s["running"], s["done"], F.concat(s["out"], row(e["attempt"], none, at, "ignored")))
            return F.when(begins, state(s["attempt"] + 1, at, F.lit(True), none, s["out"])).when(counts | late | fails, ended).when(e["rank"] == 1, ignored).otherwise(s)

        # a lambda of one element binds the expired state once
        return F.get(F.transform(F.array(expired(before, at)), seen), 0)

    known = _known(events, key).filter(F.col("at") <= F.unix_micros(until.cast("timestamp")))
    jobs = known.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "rank", "attempt"))).alias("events"))
    folded = jobs.select(key, F.aggregate("events", start, step).alias("s"))
    ended = folded.select(key, F.explode(expired(F.col("s"), F.unix_micros(until.cast("timestamp")))["out"]).alias("o"))
    return ended.select(key, "o.attempt", F.timestamp_micros("o.started").alias("started"), F.timestamp_micros("o.ended").alias("ended"), "o.outcome")


# stream


def _expire(state: dict, at: int, stale: int, forget: int) -> list[tuple]:
    out = []
    if state["running"] and at >= state["started"] + stale:
        out.append((state["attempt"], state["started"], state["started"] + stale, "stale"))
        state["running"] = False
    if state["done"] is not None and at >= state["done"] + forget:
        state |= {"attempt": 0, "done": None}
    return out


def _step(state: dict, at: int, rank: int, attempt: int) -> list[tuple]:
    mine = attempt == state["attempt"] > 0
    if rank == 3:
        if state["done"] is None and not state["running"]:
            state |= {"attempt": state["attempt"] + 1, "started": at, "running": True}
        return []
    if mine and (state["running"] or rank == 1 and state["done"] is None):
        outcome = "failed" if rank == 2 else "done" if state["running"] else "done late"
        state |= {"running": False, "done": at if rank == 1 else None}
        return [(attempt, state["started"], at, outcome)]
    return [(attempt, None, at, "ignored")] if rank == 1 else []


def _processor(name: str, stale: int, forget: int):
    from pyspark.sql.streaming import StatefulProcessor

    class Jobs(StatefulProcessor):
        """Waiting events of a job by time, and what its attempts have come to."""

        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("job", _STATE)
            self.waiting = handle.getMapState("waiting", "at long, rank int, attempt int", "n int")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            for r in rows:
                place = (r["at"], r["rank"], r["attempt"])
                n = self.waiting.getValue(place)[0] if self.waiting.containsKey(place) else 0
                self.waiting.updateValue(place, (n + 1,))
                self.handle.registerTimer(r["at"] // 1000)
            yield from ()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
            s = self.state.get() if self.state.exists() else (0, None, False, None)
            state = {"attempt": s[0], "started": s[1], "running": s[2], "done": s[3]}
            due = sorted(tuple(k) for k in self.waiting.keys() if k[0] <= now)
            out = []
            for at, rank, attempt in due:
                for _ in range(self.waiting.getValue((at, rank, attempt))[0]):
                    out += _expire(state, at, stale, forget)
                    out += _step(state, at, rank, attempt)
                self.waiting.removeKey((at, rank, attempt))
            out += _expire(state, now, stale, forget)
            if state["attempt"]:
                self.state.update((state["attempt"], state["started"], state["running"], state["done"]))
                ends = state["started"] + stale if state["running"] else state["done"] + forget if state["done"] is not None else None
                if ends is not None:
                    self.handle.registerTimer(-(-ends // 1000))
            elif self.state.exists():  # forgotten
                self.state.clear()
            for attempt, started, ended, outcome in out:
                yield Row(**{name: key[0], "attempt": attempt, "started": started, "ended": ended, "outcome": outcome})

        def close(self) -> None:
            pass

    return Jobs()


def stream_attempts(events: DataFrame, key: str, stale: int = CONTROL_STALE, forget: int = FORGET, late: str = "10 minutes") -> DataFrame:
    """``attempts`` over a stream of events; a row comes out once the watermark has passed its end.

    State is keyed and lies in the state store (RocksDB: ``spark.sql.streaming.stateStore.providerClass``), so a restart from the checkpoint goes on
    where it stopped.
    """
    known = _known(events.withWatermark("ts", late), key)
    kind = known.schema[key].dataType.simpleString()
    out = known.groupBy(key).transformWithState(_processor(key, stale * 1_000_000, forget * 1_000_000), f"{key} {kind}, attempt int, started long, ended long, outcome string", "append", "EventTime")
    return out.select(key, "attempt", F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"), "outcome")
