from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions.envelope import is_error, is_success
from millrace.operators import aggregate as A
from millrace.operators import basic as B
from millrace.operators import flow as L
from millrace.operators import resilience as S
from millrace.operators import route as R
from millrace.operators import window as W
from millrace.plans.pipelines import pipeline
from millrace.sources.files import from_rows

T0 = datetime(2024, 1, 1)
MS = 1000


def at(ms: int) -> datetime:
    return T0 + timedelta(milliseconds=ms)


@pytest.fixture
def stream(spark):
    """Rows ``(value, milliseconds)``; a negative value is an error. Extra: a key."""

    def make(*rows):
        rows = [(i, v, (r[0] if r else "k"), at(ms)) for i, (v, ms, *r) in enumerate(rows)]
        return from_rows(spark, rows, "id int, value int, key string, at timestamp_ntz", "at", "id", failed=F.col("value") < 0)

    return make


def values(df, c="value"):
    return [r[0] for r in df.orderBy("_ts", "_seq").select(c).collect()]


def test_mapper_failures_become_errors(stream):
    out = B.mapper(stream((1, 0), (-2, 1), (3, 2)), {"twice": F.col("value") * 2}, fails=F.col("value") == 3, message=F.lit("three"), name="m")
    rows = out.orderBy("_seq").collect()
    assert [(r.twice, r._err and r._err.message, r._err and r._err.processor) for r in rows] == [(2, None, None), (None, "failed", "m"), (None, "three", "m")]
    assert rows[1]._err.item is None and all(not r._meta for r in rows)


def test_async_mapper_keeps_order(stream):
    def fn(pdf):
        return pd.DataFrame({"s": "item-" + pdf["value"].astype(str), "_message": None}, index=pdf.index)

    assert values(B.async_mapper(stream(*[(i, i) for i in range(10)]), fn, "s string", workers=3), "s") == [f"item-{i}" for i in range(10)]


def test_filter_null_is_false_and_errors_pass(stream):
    df = stream((1, 0), (5, 1), (-1, 2)).withColumn("maybe", F.when(F.col("value") == 5, True))
    out = B.filter_ok(df, F.col("maybe"), name="f")
    assert values(out) == [5, -1]
    assert out.filter(is_error()).first()._err.processor == "f"


def test_tap_observes_and_swallows(stream):
    df, seen = B.tap(stream((1, 0), (-1, 1)), {"n": F.count("*"), "bad": F.count_if(is_error())}, name="watch")
    df.collect()
    assert seen.get == {"n": 2, "bad": 1}

    def bad(_):
        raise RuntimeError("no")

    assert B.tap_rows(stream((1, 0), (2, 1)), bad).count() == 2


@pytest.mark.parametrize("rate", [-0.1, 1.1, float("nan"), float("inf")])
def test_sample_rejects_bad_rates(stream, rate):
    with pytest.raises(ValueError, match="rate"):
        B.sample(stream((1, 0)), rate)


def test_sample_bounds_and_errors(spark, stream):
    df = stream(*[(i if i % 10 else -1, i) for i in range(2000)])
    assert B.sample(df, 0).filter(is_success()).count() == 0 and B.sample(df, 1).count() == 2000
    out = B.sample(df, 0.3, seed=4)
    assert out.filter(is_error()).count() == 200 and 400 < out.filter(is_success()).count() < 680


def test_batches_by_size(stream):
    out = L.batch(stream(*[(i, i) for i in range(1, 6)]), 3)
    assert values(out, "batch_id") == [1, 1, 1, 2, 2]
    items = L.collect_batches(out, ["value"]).orderBy("batch_id").collect()
    assert [[x.value for x in r["items"]] for r in items] == [[1, 2, 3], [4, 5]]


def test_batch_ends_exactly_at_its_latency(stream):
    out = L.batch(stream((1, 0), (2, 99), (3, 100), (-1, 150), (4, 199), (5, 200)), 10, 100 * MS)
    assert values(out.filter(is_success()), "batch_id") == [1, 1, 2, 2, 3]
    assert values(out.filter(is_error()), "batch_id") == [None]
    assert values(L.batch(stream((1, 0), (2, 1)), 0), "batch_id") == [1, 2]


def test_throttle_boundary_and_dropped_rows(stream):
    assert values(L.throttle(stream((1, 0), (2, 50), (3, 99), (4, 100), (-1, 101), (5, 199), (6, 200)), 100 * MS)) == [1, 4, -1, 6]
    assert values(L.throttle(stream((1, 0), (2, 0)), 0)) == [1, 2]


def test_debounce_boundary(stream):
    out = L.debounce(stream((1, 0), (2, 100), (3, 150), (-1, 160), (4, 300)), 100 * MS)
    assert values(out.filter(is_success())) == [1, 3, 4]
    assert out.filter("value = 1").first().emitted_at == at(100)


def test_token_bucket(stream):
    assert values(L.token_bucket(stream((1, 0), (2, 1), (3, 2), (4, 100), (5, 150)), 100 * MS, burst=2)) == [1, 2, 4]


def test_sequence_operators(stream):
    df = stream(*[(i, i) for i in range(10)], (-1, 20))
    assert values(L.take(df, 3)) == [0, 1, 2, -1] and values(L.skip(df, 8)) == [8, 9, -1] and values(L.paginate(df, 4, 2)) == [4, 5, -1]
    chunks = L.chunk(df, 4).filter(is_success())
    assert values(chunks, "chunk_id") == [0] * 4 + [1] * 4 + [2] * 2 and values(chunks, "chunk_place") == [0, 1, 2, 3, 0, 1, 2, 3, 0, 1]
    assert values(L.dropping_buffer(df, 3, ["key"]).filter(is_success()), "dropped_count") == [7, 7, 7]
    assert values(L.sliding_buffer(df, 3, {"s": F.sum("value")}, ["key"]).filter(is_success()), "s") == [0, 1, 3, 6, 9, 12, 15, 18, 21, 24]


def test_unbatch_and_flatten(spark):
    df = spark.createDataFrame([(1, [[1, 2], [3]]), (2, []), (3, None)], "id int, v array<array<int>>")
    assert sorted(tuple(r) for r in L.unbatch(L.flatten(df, "v"), "v").collect()) == [(1, 0, 1), (1, 1, 2), (1, 2, 3)]


def test_dedupe(stream):
    df = stream((1, 0, "a"), (2, 10, "a"), (3, 100, "a"), (4, 100, "b"), (-1, 101, "a"))
    assert values(L.dedupe(df, ["key"], None)) == values(L.dedupe(df, ["key"])) == [1, 4, -1] and values(L.dedupe(df, ["key"], 100 * MS)) == [1, 3, 4, -1]


def test_fan_in_and_out(stream):
    df = stream((1, 0), (-1, 1))
    assert R.fan_in(*R.fan_out(df, 3)).count() == 6 == R.fan_out_long(df, 3).count()
    with pytest.raises(ValueError, match="no inputs"):
        R.fan_in()


def test_partitions(stream):
    df = stream((0, 0), (1, 1), (-1, 2), (2, 3), (3, 4))
    assert values(R.partition_round_robin(df, 3), "partition_index") == [0, 1, 0, 2, 0]
    assert values(R.partition_custom(df, F.col("value") - 1, 2), "partition_index") == [0, 0, 0, 1, 0]
    same = R.partition_hash(stream((1, 0, "apple"), (2, 1, "banana"), (3, 2, "apple")), "key", 7)
    assert values(same, "partition_index") == [1, 3, 1]
    with pytest.raises(ValueError, match="positive"):
        R.partition_hash(df, "key", 0)
    uniform = R.partition_hash(df.sparkSession.range(70_000).selectExpr("id", "current_timestamp()::timestamp_ntz as at").transform(
        lambda d: __import__("millrace.functions.envelope", fromlist=["wrap"]).wrap(d, "at", "id")), "id", 7)
    counts = [r.n for r in R.partition_stats(uniform).collect()]
    assert sum((c - 10_000) ** 2 / 10_000 for c in counts) <= 20


def test_switch(spark):
    rows = [(1, 100.0, 0.1), (2, 15_000.0, 0.2), (3, 500.0, 0.9), (4, 25_000.0, 0.95), (5, -1.0, 0.0)]
    df = from_rows(spark, [(*r, T0) for r in rows], "id int, amount double, risk double, at timestamp_ntz", "at", "id", failed=F.col("id") == 5)
    key = R.first_match({"high_value": F.col("amount") > 10_000, "fraud": F.col("risk") > 0.8}, "standard")
    s = R.Switch(key).add_route("high_value").add_route("fraud").add_route("standard")
    assert values(s.process(df), "route") == ["standard", "high_value", "fraud", "high_value", R.Switch.ERROR]
    assert s.remove_route("fraud") and not s.has_route("fraud") and s.route_keys() == ["high_value", "standard"]
    assert s.process(df).count() == 4
    assert {k: v.count() for k, v in s.outputs(df).items()} == {"high_value": 2, "standard": 1, R.Switch.ERROR: 1}
    with pytest.raises(ValueError, match="default"):
        R.Switch(key, default="x").process(df)
    assert R.Switch(key, fails=F.col("id") == 1).add_route("fraud").process(df).filter("route = '__error__'").count() == 2


def test_router_and_split(stream):
    df = stream((1, 0), (2, 1), (12, 2), (-1, 3))
    routes = {"even": F.col("value") % 2 == 0, "large": F.col("value") > 10}
    assert values(R.router(df, routes), "route") == ["even", "even", None]
    assert sorted(str(r.route) for r in R.router(df, routes, default="rest", all_matches=True).collect()) == ["None", "even", "even", "large", "rest"]
    out = R.router(df, routes, processors={"large": lambda d: d.withColumn("value", F.lit(0)), "even": lambda d: d.withColumn("value", F.col("value") + 100)})
    assert sorted(values(out)) == [-1, 102, 112]
    yes, no = R.split(df, F.when(F.col("value") != 1, F.col("value") > 1))
    assert values(yes) == [2, 12] and values(no) == [1, -1]
    good, bad = R.dead_letter(df)
    assert good.count() + bad.count() == df.count()


def test_tumbling_has_errors_and_half_open_ends(stream):
    out = W.tumbling(stream((1, 0), (-1, 49), (2, 50)), 50 * MS)
    assert values(out, "window_start") == [at(0), at(0), at(50)]
    assert [tuple(r)[2:] for r in W.collect_windows(out).orderBy("window_start").collect()] == [(2, 1, 1), (1, 1, 0)]
    assert [r["items"] for r in W.collect_values(out, "value").orderBy("window_start").collect()] == [[1], [2]]


@pytest.mark.parametrize(("slide", "rows", "want"), [
    (50, [(1, 0), (2, 30), (3, 60)], {0: [1, 2, 3], 50: [3]}), (25, [(1, 0), (2, 50)], {0: [1, 2], 50: [2]})])
def test_sliding_windows_open_with_a_row(stream, slide, rows, want):
    out = W.sliding(stream(*rows), 100 * MS, slide * MS)
    got = {}
    for r in out.orderBy("value").collect():
        got.setdefault((r.window_start - T0) // timedelta(milliseconds=1), []).append(r.value)
    assert got == want


def test_sliding_equals_a_simulation(stream):
    import random

    rng = random.Random(2)
    times = sorted(rng.sample(range(2000), 60))
    size, slide, windows = 100, 30, {}
    for i, t in enumerate(times):
        for s in windows:
            if s <= t < s + size:
                windows[s].append(i)
        own = times[0] + (t - times[0]) // slide * slide
        if own not in windows:
            windows[own] = [i]
    out = W.sliding(stream(*[(i, t) for i, t in enumerate(times)]), size * MS, slide * MS)
    got = {}
    for r in out.orderBy("value").collect():
        got.setdefault((r.window_start - T0) // timedelta(milliseconds=1), []).append(r.value)
    assert got == windows
    with pytest.raises(ValueError, match="gaps"):
        W.sliding(stream((1, 0)), 10, 20)


def test_sessions(stream):
    df = stream((1, 0, "u1"), (2, 10, "u2"), (3, 100, "u1"), (4, 201, "u1"), (-1, 210, "u2"))
    out = W.session(df, "key", 100 * MS)
    got = sorted({(r.session_key, r.window_start, r.window_end) for r in out.collect()})
    assert got == [("u1", at(0), at(200)), ("u1", at(201), at(301)), ("u2", at(10), at(110)), ("u2", at(210), at(310))]
    native = W.sessions(df, "key", 100 * MS, {"n": F.count("*")})
    assert sorted((r.key, r.window_start, r.window_end) for r in native.collect()) == got


def test_aggregates(stream):
    df = stream(*[(i, i * 10) for i in range(1, 8)], (-1, 5))
    out = A.by_count(df, 3, {"s": F.sum("value")}).orderBy("emission").collect()
    assert [(r.n, r.s) for r in out] == [(3, 6), (3, 15), (1, 7)]
    out = A.by_time(stream((1, 0), (2, 250)), 100 * MS, {"s": F.sum("value")}, empty=True).orderBy("start_ts").collect()
    assert [(r.n, r.s) for r in out] == [(1, 1), (0, None), (1, 2)]
    out = A.by_either(stream((1, 0), (2, 10), (3, 20), (4, 130)), 3, 100 * MS, {"s": F.sum("value")}, ["key"]).orderBy("emission").collect()
    assert [(r.n, r.s) for r in out] == [(3, 6), (1, 4)]


def test_retry_and_backoff(spark, stream):
    def fn(row, n):
        if row["value"] >= n:
            raise ValueError(f"try {n}")
        return row["value"]

    rows = S.retry(stream((0, 0), (1, 1), (5, 2), (-1, 3)), fn, "int", 3).orderBy("_seq").collect()
    assert [(r.result, r.attempts, r.failure) for r in rows] == [(0, 1, None), (1, 2, None), (None, 3, "try 3"), (None, None, None)]
    assert rows[0].waited == 0 and 50_000 <= rows[1].waited <= 100_000
    assert S.retry(stream((5, 0)), fn, "int", 3, again=lambda m, n: False).first().attempts == 1
    waits = [r[0] for r in spark.range(1, 13).select(S.delay(F.col("id"))).collect()]
    assert waits[:4] == [0, 100_000, 200_000, 400_000] and waits[-1] == 30_000_000


def test_circuit_breaker(stream):
    rows = [(1, 0), (-1, 1), (-1, 2), (1, 3), (1, 50), (1, 103), (-1, 104), (1, 204), (1, 205)]
    out = S.circuit_breaker(stream(*rows), is_error(), ["key"], rate=0.5, least=3, pause=100 * MS, probes=2).orderBy("_seq").collect()
    assert [r.outcome for r in out] == ["passed", "failed", "failed", "rejected", "rejected", "passed", "failed", "passed", "passed"]
    assert [r.circuit for r in out] == ["closed", "closed", "open", "open", "open", "half-open", "open", "half-open", "closed"]


def test_pipeline_composes(stream):
    run = pipeline(lambda d: B.filter_ok(d, F.col("value") % 2 == 0), lambda d: B.mapper(d, {"value": F.col("value") * 2}), lambda d: L.batch(d, 50))
    out = run(stream(*[(i, i) for i in range(1000)])).groupBy("batch_id").count().collect()
    assert len(out) == 10 and all(r["count"] == 50 for r in out)
