"""Counting operators on streams go on over micro-batches and restarts; state is read back."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions.envelope import is_success, wrap
from millrace.operators import aggregate as A
from millrace.operators import flow as L
from millrace.operators import route as R
from millrace.sources.files import read_stream
from millrace.streaming import numbered, state, stateful

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def parts(spark):
    """Three parts of a stream, in order of time, with ties and errors."""
    rows = [(i, T0 + timedelta(seconds=i // 3), i % 4 if i % 5 else None, float(i % 17), i % 9 == 0) for i in range(300)]
    schema = "id long, at timestamp_ntz, key long, x double, bad boolean"
    return [spark.createDataFrame(rows[a:b], schema) for a, b in ((0, 110), (110, 115), (115, 300))]


def envelope(df):
    return wrap(df, "at", "id", failed=F.col("bad"))


@pytest.fixture
def run(spark, parts, tmp_path):
    """``run(start)``: the query that ``start(stream, folder)`` begins, over two micro-batches, then begun again over a third."""

    def go(start):
        path = str(tmp_path / "in")
        for group in (parts[:2], parts[2:]):
            for p in group:
                p.coalesce(1).write.mode("append").parquet(path)
            stream = envelope(read_stream(spark, path, parts[0].schema, files_per_trigger=1))
            start(stream, str(tmp_path / "query")).awaitTermination()
        return tmp_path

    return go


@pytest.fixture
def batch(parts):
    return envelope(parts[0].union(parts[1]).union(parts[2]))


def to_parquet(out, folder):
    return out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize(("transform", "whole", "columns"), [
    (numbered.take(120), lambda d: L.take(d, 120), ["id"]), (numbered.skip(100), lambda d: L.skip(d, 100), ["id"]),
    (numbered.chunk(7), lambda d: L.chunk(d, 7), ["id", "chunk_id", "chunk_place"]), (numbered.round_robin(5), lambda d: R.partition_round_robin(d, 5), ["id", "partition_index"])])
def test_numbers_go_on(spark, run, batch, transform, whole, columns):
    folder = run(lambda stream, f: numbered.numbered_sink(stream, transform, lambda d, n: d.select(*columns).write.mode("overwrite").parquet(f"{f}/out/{n}"), f))
    assert rows(spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/query/out"), *columns) == rows(whole(batch), *columns)


def test_a_batch_that_runs_again_has_the_same_numbers(spark, run, batch):
    failed = []

    def sink(d, n):
        d.select("id", "chunk_id").write.mode("overwrite").parquet(f"{sink.folder}/out/{n}")
        if n == 1 and not failed:
            failed.append(n)
            raise RuntimeError("lost after writing")

    def start(stream, f):
        sink.folder = f
        q = numbered.numbered_sink(stream, numbered.chunk(10), sink, f)
        try:
            q.awaitTermination()
        except Exception:
            q = numbered.numbered_sink(stream, numbered.chunk(10), sink, f)
        return q

    folder = run(start)
    assert failed == [1]
    assert rows(spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/query/out"), "id", "chunk_id") == rows(L.chunk(batch, 10), "id", "chunk_id")


def test_numbers_by_key(spark, run, batch):
    columns = ["id", "key"]
    folder = run(lambda stream, f: to_parquet(numbered.chunk_by_key(stream, 4, ["key"], columns), f))
    got = spark.read.parquet(f"{folder}/query/out")
    want = L.chunk(batch, 4, ["key"]).filter(is_success())
    assert rows(got, "id", "chunk_id", "chunk_place") == rows(want, "id", "chunk_id", "chunk_place")


def test_take_and_skip_by_key(spark, run, batch):
    folder = run(lambda stream, f: to_parquet(numbered.take_by_key(stream, 30, ["key"], ["id", "key"]), f))
    taken = rows(spark.read.parquet(f"{folder}/query/out"), "id")
    n = L.number_successes(batch, ["key"])
    assert taken == rows(n.filter("_n <= 30"), "id")


def test_newest_rows(spark, run, batch):
    folder = run(lambda stream, f: to_parquet(numbered.dropping_buffer(stream, 6, ["key"], ["id", "key"]), f))
    got = spark.read.parquet(f"{folder}/query/out")
    last = got.groupBy(F.col("key").alias("k")).agg(F.max("seen").alias("most"))
    got = got.join(last, F.col("key").eqNullSafe(F.col("k")) & (F.col("seen") == F.col("most")))
    assert rows(got, "id", "dropped_count") == rows(L.dropping_buffer(batch, 6, ["key"]).filter(is_success()), "id", "dropped_count")


def test_moving_values(spark, run, batch):
    folder = run(lambda stream, f: to_parquet(numbered.sliding_buffer(stream, 5, "x", sum, "total double", ["key"], ["id", "key", "x"]), f))
    want = L.sliding_buffer(batch, 5, {"total": F.sum("x")}, ["key"]).filter(is_success())
    assert rows(spark.read.parquet(f"{folder}/query/out"), "id", "total") == rows(want, "id", "total")


def test_current_state_is_the_fold_so_far(spark, parts, run, batch):
    fold = lambda a, x: (a * 31 + x) % 1_000_003
    folder = run(lambda stream, f: to_parquet(stateful.fold_by_count(stream, 8, 7, fold, ["id"], "bigint", ["key"]), f))
    checkpoint = f"{folder}/query/checkpoint"

    def want(df):
        out = A.fold_by_count(df, 8, F.lit(7).cast("long"), lambda a, x: (a * 31 + x["id"]) % 1_000_003, ["id"], ["key"]).collect()
        keys = {r.key for r in out}
        own = {k: [r for r in out if r.key == k] for k in keys}
        return sorted(((k, sum(r.n == 8 for r in v), next((r.n for r in v if r.n < 8), 0), next((r.state for r in v if r.n < 8), 7)) for k, v in own.items()), key=repr)

    assert rows(state.fold_state(spark, checkpoint, ["key"], "bigint"), "key", "emissions", "n", "state") == want(batch)
    assert rows(state.fold_state(spark, checkpoint, ["key"], "bigint", batch=0), "key", "emissions", "n", "state") == want(envelope(parts[0]))
    assert rows(state.fold_state(spark, checkpoint, ["key"], "bigint", batch=1), "key", "emissions", "n", "state") == want(envelope(parts[0].union(parts[1])))
