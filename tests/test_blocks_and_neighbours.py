"""Array forms of token bucket and circuit breaker equal their steps; neighbours are found over ranges."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import ordering
from millrace.functions.envelope import is_error, is_success, wrap
from millrace.operators import aggregate as A
from millrace.operators import flow as L
from millrace.operators import resilience as S

T0 = datetime(2024, 1, 1)


def stepped(step, *columns):
    state, out = None, []
    for values in zip(*columns):
        state, result = step(state, *values)
        out.append(result)
    return out


def blocked(block, rng, *columns):
    n, state, out = len(columns[0]), None, []
    cuts = sorted(rng.sample(range(1, n), min(n - 1, rng.randint(0, 4))))
    for a, b in zip([0, *cuts], [*cuts, n]):
        state, results = block(state, *(c[a:b] for c in columns))
        out += list(zip(*(r.tolist() for r in results)))
    return out


def test_token_bucket_blocks_equal_steps():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(1, 200)
        us = np.array(sorted(rng.randint(0, rng.choice([5, 100, 2000, 50_000])) for _ in range(n))) + rng.choice([0, 10**15])
        interval, burst = rng.choice([1, 7, 100]), rng.choice([1, 2, 5, 40])
        assert blocked(L.bucket_block(interval, burst), rng, us) == stepped(L.bucket_step(interval, burst), us.tolist())


def test_circuit_breaker_blocks_equal_steps():
    rng = random.Random(2)
    for _ in range(400):
        n = rng.randint(1, 300)
        us = np.array(sorted(rng.randint(0, rng.choice([50, 3000])) for _ in range(n)))
        share = rng.choice([0.0, 0.1, 0.5, 0.9])
        failed = np.array([rng.random() < share for _ in range(n)])
        args = (rng.choice([0.1, 0.3, 0.5, 1.0]), rng.choice([1, 3, 20]), rng.choice([1, 30, 500]), rng.choice([1, 2, 4]))
        assert blocked(S.breaker_block(*args), rng, us, failed) == stepped(S.breaker_step(*args), us.tolist(), failed.tolist())


def frame(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "a", "b"]), T0 + timedelta(milliseconds=rng.choice([rng.randint(0, 5000), 777])), rng.random() < 0.2) for i in range(900)]
    return wrap(spark.createDataFrame(rows, "id long, key string, at timestamp_ntz, bad boolean").repartition(3), "at", "id", failed=F.col("bad"))


def test_operators_over_batches(spark):
    df = frame(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "41")
    try:
        got = {r.id for r in L.token_bucket(df, 90_000, 3, ["key"]).filter(is_success()).collect()}
        circuits = {r.id: (r.outcome, r.circuit) for r in S.circuit_breaker(df, is_error(), ["key"], 0.3, 5, 100_000, 2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    us = lambda r: int((r._ts - T0) / timedelta(microseconds=1))
    kept, states = set(), {}
    for key in (None, "a", "b"):
        mine = sorted((r for r in df.collect() if r.key == key), key=lambda r: (r._ts, r.id))
        good = [r for r in mine if not r.bad]
        kept |= {r.id for r, (k,) in zip(good, stepped(L.bucket_step(90_000, 3), [us(r) for r in good])) if k}
        states |= {r.id: x for r, x in zip(mine, stepped(S.breaker_step(0.3, 5, 100_000, 2), [us(r) for r in mine], [r.bad for r in mine]))}
    assert got == kept and circuits == states


def test_neighbours_over_ranges(spark):
    df = frame(spark).withColumn("us", F.unix_micros(F.col("_ts").cast("timestamp")))
    w = Window.orderBy("us", "id")
    want = {r.id: (r.a, r.b) for r in df.select("id", F.lead("us").over(w).alias("a"), F.lag("us").over(w).alias("b")).collect()}
    for ranges in (1, 4, 40):
        out = ordering.with_neighbour(ordering.with_neighbour(df, "us", "id", "a", True, ranges), "us", "id", "b", False, ranges)
        assert {r.id: (r.a, r.b) for r in out.select("id", "a", "b").collect()} == want
    assert ordering.with_neighbour(df.limit(0), "us", "id", "a").count() == 0


def test_debounce_and_monitor_without_keys(spark):
    df = frame(spark)
    one = df.withColumn("all", F.lit(1))
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert rows(L.debounce(df, 9_000).select("id", "emitted_at")) == rows(L.debounce(one, 9_000, ["all"]).select("id", "emitted_at"))
    assert rows(A.monitor(df, 500_000)) == rows(A.monitor(one, 500_000, ["all"]))
    plan = L.debounce(df, 9_000)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
