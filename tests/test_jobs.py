"""Attempts of background reads: cases, a fold in plain Python, and the stream with lost workers, late results and a restart."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from plumbline.streaming import jobs

T0 = datetime.datetime(2024, 3, 1, tzinfo=datetime.timezone.utc)
SCHEMA = "job string, ts timestamp, kind string, attempt int"


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def rows(df):
    return sorted(((r["job"], r["attempt"], r["started"], r["ended"], r["outcome"]) for r in df.collect()), key=str)


def local(seconds):
    return None if seconds is None else at(seconds).astimezone().replace(tzinfo=None)


CASES = {
    "done": ([(0, "request", None), (10, "request", None), (100, "result", 1), (200, "request", None)], [(1, 0, 100, "done")]),
    "failed, then done": ([(0, "request", None), (5, "failure", 1), (6, "request", None), (9, "result", 2)], [(1, 0, 5, "failed"), (2, 6, 9, "done")]),
    "lost worker": ([(0, "request", None), (479, "request", None), (480, "request", None), (500, "result", 2)], [(1, 0, 480, "stale"), (2, 480, 500, "done")]),
    "late result": ([(0, "request", None), (600, "result", 1), (700, "request", None)], [(1, 0, 480, "stale"), (1, 0, 600, "done late")]),
    "replaced": ([(0, "request", None), (500, "request", None), (510, "result", 1), (520, "result", 2), (530, "result", 2)], [(1, 0, 480, "stale"), (1, None, 510, "ignored"), (2, 500, 520, "done"), (2, None, 530, "ignored")]),
    "failure of a replaced one": ([(0, "request", None), (490, "request", None), (500, "failure", 1), (510, "failure", 2)], [(1, 0, 480, "stale"), (2, 490, 510, "failed")]),
    "never asked for": ([(0, "result", 1), (1, "failure", 1), (2, "nonsense", 1)], [(1, None, 0, "ignored")]),
    "forgotten": ([(0, "request", None), (1, "result", 1), (86_400, "request", None), (86_401, "request", None), (86_402, "result", 1)], [(1, 0, 1, "done"), (1, 86_401, 86_402, "done")]),
    "running": ([(90_000, "request", None)], []),
    "same time": ([(0, "request", None), (7, "request", None), (7, "failure", 1), (7, "result", 1)], [(1, 0, 7, "done")]),
}
END = 90_100


def frame(spark, cases):
    return spark.createDataFrame([(job, at(s), kind, a) for job, events in cases.items() for s, kind, a in events], SCHEMA)


def test_cases(spark):
    df = frame(spark, {k: e for k, (e, _) in CASES.items()}).unionByName(spark.createDataFrame([(None, at(1), "request", None), ("x", None, "request", None)], SCHEMA))
    want = [(k, a, local(s), local(e), o) for k, (_, out) in CASES.items() for a, s, e, o in out]
    assert rows(jobs.attempts(df, "job", F.lit(at(END)))) == sorted(want, key=str)
    assert rows(jobs.attempts(df.filter("false"), "job", F.lit(at(END)))) == []


def fold(events, end, stale, forget):
    state, out = {"attempt": 0, "started": None, "running": False, "done": None}, []
    for s, rank, a in sorted((s, jobs.KINDS.index(k) + 1, a or 0) for s, k, a in events):
        out += jobs._expire(state, s, stale, forget) + jobs._step(state, s, rank, a)
    return out + jobs._expire(state, end, stale, forget)


def random_events(seed, n_jobs=30, n=25):
    rng = random.Random(seed)
    kinds = ("request",) * 4 + ("result", "failure")
    return {f"j{k}": [(rng.randint(0, 4000), kind := rng.choice(kinds), None if kind == "request" else rng.choice((1, 1, 2, 3))) for _ in range(rng.randint(1, n))] for k in range(n_jobs)}


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_equals_a_fold(spark, seed):
    cases = random_events(seed)
    got = rows(jobs.attempts(frame(spark, cases), "job", F.lit(at(6000)), stale=300, forget=900))
    assert got == sorted(((k, a, local(s), local(e), o) for k, ev in cases.items() for a, s, e, o in fold(ev, 6000, 300, 900)), key=str)


@pytest.mark.parametrize("restart", [False, True])
def test_stream_equals_batch(spark, tmp_path, restart):
    """Events arrive in files, out of order within the watermark; a restart from the checkpoint changes nothing."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    cases = random_events(5, n_jobs=24, n=14)
    flat = sorted((s, job, kind, a) for job, ev in cases.items() for s, kind, a in ev)
    rng = random.Random(2)
    flat.sort(key=lambda r: r[0] + rng.randint(0, 500))  # late by up to 500 s
    third = -(-len(flat) // 3)
    parts = [flat[k : k + third] for k in range(0, len(flat), third)] + [[(9000, "clock", "request", None)], [(9900, "clock", "request", None)]]
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))

    def feed(part):
        spark.createDataFrame([(j, at(s), k, a) for s, j, k, a in part], SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        q = jobs.stream_attempts(stream, "job", stale=300, forget=900).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    try:
        for k, part in enumerate(parts):
            feed(part)
            if restart and k in (1, 2):
                run()
        run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [r for r in rows(spark.read.parquet(out)) if r[0] != "clock"]
    want = rows(jobs.attempts(frame(spark, cases), "job", F.lit(at(9000)), stale=300, forget=900))
    assert got == want and {r[4] for r in want} >= {"stale", "done", "failed", "ignored", "done late"}
