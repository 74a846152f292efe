"""Statistics of running streams: those of all micro-batches equal the batch form's, after a lost batch as well."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions.envelope import is_error, wrap
from millrace.operators.aggregate import monitor
from millrace.sources.files import read_stream
from millrace.streaming.monitoring import monitored_sink, open_statistics, tap_stream

T0, SECOND = datetime(2024, 1, 1), 1_000_000
SCHEMA = "id long, at timestamp_ntz, took long, bad boolean"


@pytest.fixture
def streams(spark, tmp_path):
    """Three micro-batches of given times in seconds; an envelope as a stream and as a table."""

    def make(parts):
        number = 0
        for part in parts:
            rows = []
            for t in part:
                rows.append((number, None if t is None else T0 + timedelta(seconds=t), 10 * number, number % 5 == 4))
                number += 1
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            time.sleep(0.05)  # files are taken by their times
        stream = read_stream(spark, str(tmp_path / "in"), SCHEMA, files_per_trigger=1)
        return [wrap(x, "at", "id", failed=F.col("bad")) for x in (stream, spark.read.schema(SCHEMA).parquet(str(tmp_path / "in")))]

    return make


PARTS = [[0, 1.5, 1.5, 12, 9], [14, 25, 31, 31], [33, 47.25, 58, 40]]


def test_intervals_equal_the_batch_form(spark, streams, tmp_path):
    """Intervals that reach over micro-batches, ties and rows out of order within a batch, an empty interval between."""
    stream, table = streams(PARTS)
    told, seen = [], []
    monitored_sink(stream, 10 * SECOND, told.append, lambda df, _: seen.extend(r.id for r in df.collect()), str(tmp_path / "q")).awaitTermination()
    rest = open_statistics(spark, str(tmp_path / "q"), 10 * SECOND, 2).collect()
    want = sorted(monitor(table, 10 * SECOND).collect())
    assert told + rest == want and len(want) == 6 and len(rest) == 1
    assert sorted(seen) == list(range(13)) and [r.start_ts for r in told] == sorted(r.start_ts for r in told)


def test_a_batch_that_runs_again_tells_the_same(spark, streams, tmp_path):
    stream, table = streams(PARTS)
    told, failed = [], []

    def sink(df, number):
        if number == 1 and not failed:
            failed.append(1)
            raise RuntimeError("lost before telling")

    def start():
        monitored_sink(stream, 10 * SECOND, told.append, sink, str(tmp_path / "q")).awaitTermination()

    with pytest.raises(Exception, match="lost before telling"):
        start()
    start()
    assert told + open_statistics(spark, str(tmp_path / "q"), 10 * SECOND, 2).collect() == sorted(monitor(table, 10 * SECOND).collect())


def test_late_rows_own_latencies_and_no_times(spark, streams, tmp_path):
    """A row within the lateness counts in its interval, one beyond it in a call of its own; rows without a time in none."""
    stream, _ = streams([[1, 11, None], [2, 31], [3, None]])
    told = []
    monitored_sink(stream, 10 * SECOND, told.append, lambda df, _: None, str(tmp_path / "q"), latency=F.col("took"), lateness=5 * SECOND).awaitTermination()
    got = [((r.start_ts - T0).seconds, r.item_count, r.min_latency, r.max_latency, r.avg_latency) for r in told]
    assert got == [(0, 2, 0, 30, 15.0), (10, 1, 10, 10, 10.0), (0, 1, 50, 50, 50.0)]
    assert [(r.item_count, r.rate) for r in open_statistics(spark, str(tmp_path / "q"), 10 * SECOND, 2).collect()] == [(1, 0.1)]
    with pytest.raises(ValueError):
        monitored_sink(stream, 0, told.append, lambda df, _: None, str(tmp_path / "none"))


def test_taps_see_each_batch_and_stop_nothing(spark, streams, tmp_path):
    stream, _ = streams(PARTS)
    told = {}

    def fn(number, row):
        told[number] = (row["n"], row["errors"])
        raise RuntimeError("swallowed")

    tapped, end = tap_stream(stream, {"n": F.count("*"), "errors": F.count_if(is_error())}, fn)
    seen = []
    query = tapped.writeStream.foreachBatch(lambda df, _: seen.extend(r.id for r in df.collect())).option("checkpointLocation", str(tmp_path / "tap")).trigger(availableNow=True).start()
    query.awaitTermination()
    for _ in range(100):  # listeners are told on a thread of their own
        if len(told) == 3:
            break
        time.sleep(0.1)
    end()
    assert told == {0: (5, 1), 1: (4, 0), 2: (4, 1)} and sorted(seen) == list(range(13))  # ids 4 and 9 are errors
