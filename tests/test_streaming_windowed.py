"""Windows on streams equal their batch forms over several micro-batches, with rows out of order."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions.envelope import wrap
from millrace.operators import aggregate as A
from millrace.operators import panes as N
from millrace.operators import window as W
from millrace.sources.files import read_events, read_stream
from millrace.streaming import windowed
from millrace.streaming.windows import run_to_memory

HOUR = 3_600_000_000
DAY = 24 * HOUR


@pytest.fixture(scope="module")
def pair(spark, small, tmp_path_factory):
    """(batch, stream) envelopes of the events in four micro-batches of a file each: files overlap by hours, and the last row,
    far in the future, closes what is open."""
    path = tmp_path_factory.mktemp("windowed") / "events"
    df = read_events(spark, small).select("event_id", "ts", "user_id", "event_type", "value").withColumn("user_id", F.when(F.col("user_id") % 11 != 0, F.col("user_id") % 7))
    first = df.agg(F.min("ts")).first()[0]
    day = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(int((first - datetime(1970, 1, 1)) / timedelta(microseconds=1))) + F.pmod(F.hash("event_id"), F.lit(7)) * HOUR) / (10 * DAY))
    last = spark.createDataFrame([(10**9, datetime(2030, 1, 1), -1, "click", 0.0)], df.schema)
    for i in range(5):
        part = df.filter(day == i) if i < 4 else df.filter(day >= 4).unionByName(last)
        part.coalesce(1).write.mode("append").parquet(str(path))
    envelope = lambda d: wrap(d, "ts", "event_id", failed=F.col("event_type") == "error", message="error event")
    return envelope(spark.read.parquet(str(path))).filter("event_id < 1000000000"), envelope(read_stream(spark, str(path), df.schema, files_per_trigger=1))


def rows(df):
    df = df.filter("user_id is null or user_id >= 0")
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


MEASURES = {"high": ("max", "value"), "low": ("min", "value"), "ids": ("sum", "event_id")}


def good():
    """The measures over successes, as aggregates."""
    own = lambda c: F.when(F.col("_err").isNull(), F.col(c))
    return {"high": F.max(own("value")), "low": F.min(own("value")), "ids": F.sum(own("event_id"))}


@pytest.mark.parametrize(("size", "slide"), [(6 * HOUR, HOUR), (5 * HOUR, 2 * HOUR)])
def test_sliding_from_the_first_row(pair, size, slide):
    batch, stream = pair
    got = run_to_memory(windowed.sliding_anchored(stream, size, slide, ["user_id"], "12 hours", MEASURES), f"w_sliding_{slide}")
    want = W.collect_windows(W.sliding(batch, size, slide, ["user_id"]), ["user_id"], good())
    assert rows(got) == rows(want) and len(rows(got)) > 100
    merged = N.collect_sliding(batch, size, slide, keys=["user_id"])
    assert rows(got.select(merged.columns)) == rows(merged)


def test_sessions_of_limited_duration(pair):
    batch, stream = pair
    got = run_to_memory(windowed.session_capped(stream, ["user_id"], 12 * HOUR, 2 * DAY, "12 hours", MEASURES), "w_sessions")
    want = W.sessions(batch, "user_id", 12 * HOUR, {"item_count": F.count("*"), "success_count": F.count_if(F.col("_err").isNull()), "error_count": F.count_if(F.col("_err").isNotNull())} | good(), most=2 * DAY)
    assert rows(got) == rows(want)
    assert any(r.window_end - r.window_start == timedelta(days=2) for r in want.collect())


def test_time_windows_with_empty_ones(pair):
    batch, stream = pair
    got = run_to_memory(windowed.by_time_gapless(stream, 3 * HOUR, ["user_id"], "12 hours", MEASURES), "w_gapless")
    want = A.by_time(batch, 3 * HOUR, good(), ["user_id"], empty=True)
    assert rows(got) == rows(want) and any(r.n == 0 for r in want.collect())


def test_empty_windows_as_time_passes(pair):
    batch, stream = pair
    got = run_to_memory(windowed.by_time_gapless(stream, 3 * HOUR, ["user_id"], "12 hours", quiet=4), "w_quiet")
    starts: dict = {}
    for r in A.by_time(batch, 3 * HOUR, {}, ["user_id"]).collect():
        starts.setdefault(r.user_id, {})[r.start_ts] = r.n
    want = []
    for user, own in starts.items():
        step = timedelta(hours=3)
        for at, n in own.items():
            want.append((user, at, n))
            quiet = at + step
            while quiet not in own and quiet <= at + 4 * step:
                want.append((user, quiet, 0))
                quiet += step
    assert sorted(((r.user_id, r.start_ts, r.n) for r in got.filter("user_id is null or user_id >= 0").collect()), key=repr) == sorted(want, key=repr)


def test_bad_measures_and_sizes(pair):
    _, stream = pair
    with pytest.raises(ValueError, match="sum, min and max"):
        windowed.sliding_anchored(stream, 2, 1, ["user_id"], measures={"x": ("avg", "value")})
    with pytest.raises(ValueError, match="slide"):
        windowed.sliding_anchored(stream, 1, 2, ["user_id"])
    with pytest.raises(ValueError, match="positive"):
        windowed.session_capped(stream, ["user_id"], 0, 1)
