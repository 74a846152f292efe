"""Windows merged from panes equal windows of copied rows; sketches keep their bounds."""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions.envelope import wrap
from millrace.operators import panes as N
from millrace.operators import window as W

T0, SECOND = datetime(2024, 1, 1), 1_000_000


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(i, rng.choice([None, "a", "a", "b"]), T0 + timedelta(seconds=rng.choice([rng.randint(0, 900), rng.randint(5000, 5100)])), rng.randint(0, 99)) for i in range(700)]
    return wrap(spark.createDataFrame(data, "id long, key string, at timestamp_ntz, value long"), "at", "id", failed=F.col("value") < 10)


@pytest.mark.parametrize(("size", "slide", "keys", "anchor"), [(60, 1, [], None), (100, 30, ["key"], None), (90, 60, [], None), (50, 50, ["key"], None), (70, 30, ["key"], 5), (7, 3, [], 0)])
def test_panes_equal_copied_rows(rows, size, slide, keys, anchor):
    copied = W.collect_windows(W.sliding(rows, size * SECOND, slide * SECOND, keys, anchor), keys, {
        "total": F.sum("value"), "low": F.min("value"), "high": F.max("value"), "mean": F.avg("value"), "first": F.min_by("id", F.struct("_ts", "_seq")), "last": F.max_by("id", F.struct("_ts", "_seq"))})
    v = F.col("value")
    more = {"total": N.total(v), "low": N.least(v), "high": N.greatest(v), "mean": N.mean(v), "first": N.earliest(F.col("id")), "last": N.latest(F.col("id"))}
    merged = N.collect_sliding(rows, size * SECOND, slide * SECOND, more, keys, anchor)
    as_rows = lambda d: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.select(sorted(merged.columns)).collect()), key=repr)
    assert as_rows(merged) == as_rows(copied)


def test_blocks_of_panes_meet(rows):
    counts = {"n": N.count(), "bad": N.count(F.col("value") < 10)}
    each = [sorted(map(tuple, N.sliding_aggregates(rows, 40 * SECOND, 10 * SECOND, counts, block=b).collect())) for b in (1, 17, 10_000)]
    assert each[0] == each[1] == each[2]
    assert N.sliding_aggregates(rows.limit(0), 40, 10, counts).count() == 0
    with pytest.raises(ValueError, match="gaps"):
        N.sliding_aggregates(rows, 10, 20, counts)
    with pytest.raises(ValueError, match="positive"):
        N.sliding_aggregates(rows, 10, 0, counts)


def test_rows_are_exchanged_as_panes(spark):
    df = wrap(spark.range(20_000).selectExpr("id", "timestamp_micros(id * 1000)::timestamp_ntz as at"), "at", "id")
    out = N.sliding_aggregates(df, 6 * SECOND, SECOND // 10, {"n": N.count()}, anchor=0)
    assert out.count() == 200 and out.agg(F.max("n")).first()[0] == 6000
    plan = out._jdf.queryExecution().executedPlan().toString()
    copies, summed = plan.index("Generate explode"), plan.index("partial_count(1)")
    assert copies < summed  # copied above, and so after, the sums


def rank_error(values, points, found):
    """How far, in ranks, a quantile is from its place among the sorted values."""
    return max(max(0, bisect_left(values, x) / len(values) - p, p - bisect_right(values, x) / len(values)) for p, x in zip(points, found))


def test_sketches_keep_their_bounds_over_any_intervals(spark):
    rng = random.Random(7)
    data = [(i, T0 + timedelta(seconds=rng.randint(0, 6000)), rng.lognormvariate(3, 1), rng.randint(0, 3000)) for i in range(20_000)]
    df = wrap(spark.createDataFrame(data, "id long, at timestamp_ntz, x double, user long").repartition(4), "at", "id")
    points = (0.05, 0.5, 0.95, 0.99)
    aggregates = {"q": N.quantiles(F.col("x"), points), "users": N.distinct(F.col("user")), "n": N.count()}
    kept = N.interval_sketches(df, 600 * SECOND, aggregates).persist()
    assert kept.count() == 11
    for a, b in ((0, 6001), (600, 1200), (1800, 5400)):
        at = lambda s: F.lit(T0 + timedelta(seconds=s))
        got = N.merge_intervals(kept.filter((F.col("start_ts") >= at(a)) & (F.col("start_ts") < at(b))), aggregates).first()
        mine = [r for r in data if a <= (r[1] - T0).seconds < b]
        users = len({r[3] for r in mine})
        assert got.n == len(mine) and abs(got.users - users) <= 0.07 * users
        assert rank_error(sorted(r[2] for r in mine), points, got.q) <= 0.02
    kept.unpersist()
    windows = N.sliding_aggregates(df, 1200 * SECOND, 300 * SECOND, {"q": N.quantiles(F.col("x"), (0.5,)), "n": N.count()}, anchor=0).collect()
    for w in windows:
        mine = sorted(r[2] for r in data if w.window_start <= r[1] < w.window_end)
        assert w.n == len(mine) and rank_error(mine, (0.5,), w.q) <= 0.03
    few = wrap(spark.createDataFrame([(i, T0, float(i), 1) for i in range(100)], "id long, at timestamp_ntz, x double, user long"), "at", "id")
    assert N.merge_intervals(N.interval_sketches(few, SECOND, aggregates), aggregates).first().q[1] in (49.0, 50.0)
    empty = N.merge_intervals(N.interval_sketches(few.limit(0), SECOND, aggregates), aggregates).first()
    assert (empty.q, empty.users, empty.n) == (None, 0, 0)
