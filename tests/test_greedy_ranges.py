"""Greedy chains cut into ranges equal the row-by-row rule, whatever the cuts."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import fold, ordering
from millrace.functions.envelope import wrap
from millrace.operators import flow as L
from millrace.operators import window as W

T0 = datetime(2024, 1, 1)


def by_hand(times, wait, size, gap):
    out, number, count, first, last = [], 0, 0, 0, 0
    for t in times:
        new = not number or (size and count >= size) or (wait and t - first >= wait) or (gap and t - last > gap)
        number, count, first, last = number + bool(new), 1 if new else count + 1, t if new else first, t
        out.append((number, bool(new)))
    return out


def test_chains_of_ranges_equal_the_rule():
    rng = random.Random(1)
    for _ in range(600):
        n = rng.randint(1, 60)
        times = np.array(sorted(rng.randint(0, rng.choice([5, 50, 500, 5000])) for _ in range(n))) + rng.choice([0, -100, 10**15])
        wait, size, gap = rng.choice([0, 1, 7, 40, 300]), rng.choice([0, 0, 1, 3, 10]), rng.choice([0, 0, 2, 30])
        if not (wait or size or gap):
            wait = 3
        cut = sorted(rng.sample(range(1, n), min(n - 1, rng.randint(0, 5))))
        state, starts = (0, 0, 0, 0), []
        for a, b in zip([0, *cut], [*cut, n]):
            piece, chain = times[a:b], fold.Chain(wait, size, gap)
            inner = sorted(rng.sample(range(1, b - a), min(b - a - 1, rng.randint(0, 3))))
            for x, y in zip([0, *inner], [*inner, b - a]):
                chain.add(piece[x:y])
            k = len(chain.place)
            table = np.stack([np.full(k, chain.n), np.full(k, chain.begin), np.full(k, chain.last), chain.place, chain.time, chain.first, chain.count, chain.starts])
            after = fold.follow(state, table, wait, size, gap)
            mark, own = fold.segment_starts(piece, np.array([] if state[0] else [0], np.int64), wait, size, gap, state)
            assert tuple(map(int, own)) == tuple(map(int, after))
            state = after
            starts += mark.tolist()
        assert starts == [new for _, new in by_hand(times.tolist(), wait, size, gap)]


def test_what_meets_stays_together():
    """A chain holds few entries where arrivals are random, though any of thousands of rows may start a segment first."""
    rng = np.random.default_rng(3)
    chain = fold.Chain(2000, 0, 0)
    times = np.sort(rng.integers(0, 2_000_000, 400_000))
    for block in np.array_split(times, 20):
        chain.add(block)
    assert 1 <= len(chain.place) < 60


@pytest.mark.parametrize(("wait", "size", "gap"), [(60, 0, 0), (5, 4, 0), (400, 0, 3), (400, 20, 0), (0, 7, 2)])
def test_segments_of_hot_keys_and_without_keys(spark, wait, size, gap):
    rng = random.Random(wait + size)
    rows = [(i, rng.choice([None, *["hot"] * 6, "b"]), rng.choice([rng.randint(0, 3000), 500]), rng.random() < 0.9) for i in range(2000)]
    df = spark.createDataFrame(rows, "_seq long, key string, us long, on boolean").withColumn("_ts", F.col("us")).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for keys, n in (([], None), (["key"], 9), (["key"], None)):
            out = fold.segmented(df, keys, ["_ts", "_seq"], "us", wait, size, "on", gap, n)
            got = {r._seq: (r._segment, r._starts) for r in out.collect()}
            groups: dict = {}
            for r in sorted(rows, key=lambda r: (r[2], r[0])):
                if r[3]:
                    groups.setdefault(r[1] if keys else 0, []).append(r)
            want = {r[0]: (None, None) for r in rows}
            for g in groups.values():
                want |= dict(zip([r[0] for r in g], by_hand([r[2] for r in g], wait, size, gap)))
            assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_key_with_all_rows_spreads_over_the_tasks(spark):
    df = spark.range(6000).select(F.lit("k").alias("key"), F.col("id").alias("_seq"), (F.col("id") * 7 % 5000).alias("us"), F.lit(True).alias("on")).withColumn("_ts", F.col("us"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for keys in (["key"], []):
            out = fold.segmented(df, keys, ["_ts", "_seq"], "us", 50, 0, "on", ranges=12).withColumn("task", F.spark_partition_id())
            counts = [r["count"] for r in out.groupBy("task").count().collect()]
            assert len(counts) >= 6 and max(counts) < 3000
            assert out.filter("_starts").count() == sum(new for _, new in by_hand(sorted(i * 7 % 5000 for i in range(6000)), 50, 0, 0))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranges_cut_values_that_fill_several(spark, monkeypatch):
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("a"), F.when(F.col("id") % 4 == 0, 1).otherwise(F.col("id")).alias("b"), F.col("id").alias("c"))
    bounds, full = ordering.cut_points(df, ["a", "b", "c"], 20)
    assert full == {7} and bounds == sorted(set(bounds))
    for most in (256, 3):
        monkeypatch.setattr(ordering, "MAX_TREE", most)
        rows = df.withColumn("r", ordering.range_of(bounds, ["a", "b", "c"])).collect()
        assert all(r.r == sum(b < (r.a, r.b, r.c) for b in bounds) for r in rows)
        sizes = [sum(r.r == i for r in rows) for i in range(len(bounds) + 1)]
        assert max(sizes) < 600
    assert ordering.cut_points(df.limit(0), ["a", "b", "c"], 20) == ([], set())


def test_sessions_of_limited_duration(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "u", "v"]), T0 + timedelta(seconds=rng.randint(0, 2000)), rng.random() < 0.2) for i in range(500)]
    df = wrap(spark.createDataFrame(rows, "id long, key string, at timestamp_ntz, bad boolean"), "at", "id", failed=F.col("bad"))
    second = 1_000_000
    out = W.session(df, "key", 15 * second, most=60 * second)
    got = {(r.id, r.window_start, r.window_end) for r in out.collect()}
    want = set()
    for key in (None, "u", "v"):
        mine = sorted((r[2], r[0]) for r in rows if r[1] == key)
        times = [(t - T0) // timedelta(seconds=1) for t, _ in mine]
        numbers = [n for n, _ in by_hand(times, 60, 0, 15)]
        for (_, i), n in zip(mine, numbers):
            own = [t for t, m in zip(times, numbers) if m == n]
            want.add((i, T0 + timedelta(seconds=own[0]), T0 + timedelta(seconds=min(own[-1] + 15, own[0] + 60))))
    assert got == want
    rows_ = W.sessions(df, "key", 15 * second, {"n": F.count("*")}, most=60 * second).collect()
    assert {(r.key, r.window_start, r.window_end) for r in rows_} == {(r.key, r.window_start, r.window_end) for r in out.select("key", "window_start", "window_end").distinct().collect()}
    assert sum(r.n for r in rows_) == 500 and len(rows_) == len({(r.key, r.window_start) for r in rows_})
    with pytest.raises(ValueError, match="positive"):
        W.session(df, "key", 1, most=0)


def test_greedy_operators_take_ranges(spark):
    df = wrap(spark.range(3000).selectExpr("id", "timestamp_micros(id * 1000 % 777000)::timestamp_ntz as at", "'one' as key"), "at", "id")
    ids = lambda d, *c: sorted(tuple(r) for r in d.select("id", *c).collect())
    assert ids(L.throttle(df, 5000, ["key"], ranges=7)) == ids(L.throttle(df, 5000, ["key"])) == ids(L.throttle(df, 5000))
    assert ids(L.batch(df, 9, 5000, ["key"], ranges=7), "batch_id") == ids(L.batch(df, 9, 5000, ["key"]), "batch_id") == ids(L.batch(df, 9, 5000), "batch_id")
    assert ids(L.dedupe(df, ["key"], 5000, ranges=7)) == ids(L.dedupe(df, ["key"], 5000))
