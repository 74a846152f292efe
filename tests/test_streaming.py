"""The streaming operators give what the batch ones give on the same rows."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.envelope import is_error, is_success, micros, wrap
from millrace.operators import aggregate as A
from millrace.operators import flow as L
from millrace.operators import resilience as S
from millrace.operators import window as W
from millrace.sources.files import read_events, read_stream
from millrace.streaming import stateful, windows
from millrace.streaming.windows import run_to_memory

HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def pair(spark, small, tmp_path_factory):
    """(batch, stream) envelopes of the events, in three files; a last row far in the future closes what is open."""
    path = str(tmp_path_factory.mktemp("stream") / "events")
    df = read_events(spark, small).select("event_id", "ts", "user_id", "event_type", "value")
    last = spark.createDataFrame([(10**9, datetime(2030, 1, 1), -1, "click", 0.0)], df.schema)
    df.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(path)
    last.write.mode("append").parquet(path)
    envelope = lambda d: wrap(d, "ts", "event_id", failed=F.col("event_type") == "error", message="error event")
    return envelope(spark.read.parquet(path)), envelope(read_stream(spark, path, df.schema))


def ids(df, *columns):
    return sorted(tuple(r) for r in df.select("event_id", *columns).collect())


def test_throttle_and_batches(pair):
    batch, stream = pair
    assert ids(run_to_memory(stateful.throttle(stream, 24 * HOUR, ["user_id"], ["event_id", "user_id"]), "s_throttle")) == ids(
        L.throttle(batch, 24 * HOUR, ["user_id"]).filter(is_success()))
    assert ids(run_to_memory(stateful.batch(stream, 5, 6 * HOUR, ["user_id"], ["event_id", "user_id"]), "s_batch"), "batch_id") == ids(
        L.batch(batch, 5, 6 * HOUR, ["user_id"]).filter(is_success()), "batch_id")


def test_dedupe_forgets_quiet_keys(pair):
    batch, stream = pair
    got = stateful.dedupe(stream, ["user_id"], ["event_id", "user_id"], 24 * HOUR, lateness="40 days")
    assert ids(run_to_memory(got, "s_dedupe")) == ids(L.dedupe(batch, ["user_id"], 24 * HOUR).filter(is_success()))


def test_folds_monitor_and_retry(pair):
    batch, stream = pair
    got = stateful.fold_by_count(stream, 8, 7, lambda a, x: (a * 31 + x) % 1_000_003, ["event_id"], "bigint", ["user_id"])
    want = A.fold_by_count(batch, 8, F.lit(7).cast("long"), lambda a, x: (a * 31 + x["event_id"]) % 1_000_003, ["event_id"], ["user_id"]).filter("n = 8")
    rows = lambda df: sorted(map(tuple, df.select("user_id", "emission", "state").collect()))
    assert rows(run_to_memory(got, "s_fold")) == rows(want)
    by_hour = {(r.start_ts, r.item_count, r.rate) for r in A.monitor(batch.filter("event_id < 1000000000"), HOUR).collect()}
    assert {(r.start_ts, r.item_count, r.rate) for r in run_to_memory(windows.monitor(stream, "1 hour", 3600.0), "s_monitor").collect()} == by_hour
    w = Window.partitionBy("user_id").orderBy("_ts", "_seq")
    own = batch.withColumn("latency", micros(F.col("_ts")) - F.lag(micros(F.col("_ts"))).over(w))
    assert ids(run_to_memory(stateful.latencies(stream, ["user_id"], ["event_id", "user_id"]), "s_latency").fillna(-1, ["latency"]), "latency") == ids(own.fillna(-1, ["latency"]), "latency")

    def flaky(row, n):
        if n <= row["user_id"] % 5:
            raise ValueError("not yet")
        return n

    assert ids(run_to_memory(S.retry(stream, flaky, "bigint", 3), "s_retry").filter("attempts is not null").fillna(-1, ["result"]), "result", "attempts") == ids(
        S.retry(batch, flaky, "bigint", 3).filter("attempts is not null").fillna(-1, ["result"]), "result", "attempts")


def test_circuit_breaker(pair):
    batch, stream = pair
    got = run_to_memory(stateful.circuit_breaker(stream, ["user_id"], ["event_id", "user_id"], 0.3, 5, 24 * HOUR, 2), "s_breaker")
    assert ids(got, "outcome", "circuit") == ids(S.circuit_breaker(batch, is_error(), ["user_id"], 0.3, 5, 24 * HOUR, 2), "outcome", "circuit")


def test_debounce(pair):
    batch, stream = pair
    got = run_to_memory(stateful.debounce(stream, 6 * HOUR, ["user_id"], ["event_id", "user_id"]), "s_debounce")
    want = L.debounce(batch, 6 * HOUR, ["user_id"]).filter(is_success() & (F.col("event_id") < 10**9))
    assert ids(got.filter("event_id < 1000000000")) == ids(want)


def test_windows(pair):
    batch, stream = pair
    got = run_to_memory(windows.tumbling(stream, "1 day"), "s_tumbling")
    want = W.collect_windows(W.tumbling(batch, 24 * HOUR)).filter("window_start < '2029-01-01'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got = run_to_memory(windows.session(stream, "user_id", "12 hours"), "s_session")
    want = W.sessions(batch, "user_id", 12 * HOUR, {"item_count": F.count("*")}).filter("window_start < '2029-01-01'")
    assert got.count() == want.count() and got.agg(F.sum("item_count")).first()[0] == want.agg(F.sum("item_count")).first()[0]
    got = run_to_memory(windows.sliding(stream, "30 minutes", "5 minutes"), "s_sliding")
    want = W.collect_windows(W.sliding(batch, HOUR // 2, HOUR // 12, anchor=0)).filter("window_start < '2029-01-01'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_dead_letter_sinks(pair, tmp_path):
    batch, stream = pair
    good, bad = [], []
    q = windows.dead_letter_sinks(stream, lambda d, n: good.append(d.count()), lambda d, n: bad.append(d.count()), str(tmp_path / "c"))
    q.awaitTermination()
    assert sum(good) == batch.filter(is_success()).count() and sum(bad) == batch.filter(is_error()).count()
