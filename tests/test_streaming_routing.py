"""Routes of a running switch: added and removed between micro-batches, the same when a batch runs again."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions.envelope import wrap
from millrace.operators.route import Switch
from millrace.sources.files import read_stream
from millrace.streaming.routing import RouteTable, switched_sink

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, at timestamp_ntz, kind string, bad boolean"


@pytest.fixture
def stream(spark, tmp_path):
    """Three micro-batches of nine rows of the kinds a, b and c, one of them an error."""
    for part in range(3):
        rows = [(9 * part + i, T0 + timedelta(seconds=9 * part + i), "abc"[i % 3], i == 8) for i in range(9)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return lambda: wrap(read_stream(spark, str(tmp_path / "in"), SCHEMA, files_per_trigger=1), "at", "id", failed=F.col("bad"))


def expected(routes: list[list[str]], default=None):
    out = {}
    for part, now in enumerate(routes):
        for i in range(9):
            kind = "abc"[i % 3]
            route = Switch.ERROR if i == 8 else kind if kind in now else default if default in now else None
            if route:
                out[9 * part + i] = route
    return out


def test_routes_change_between_batches(spark, stream, tmp_path):
    table, got = RouteTable(spark, str(tmp_path / "table"), ["a", "rest"]), {}

    def sink(df, number):
        got.update({r.id: r.route for r in df.collect()})
        if number == 0:
            table.add_route("b").add_route("b")
        if number == 1:
            assert table.remove_route("a") and not table.remove_route("x") and table.remove_route("rest")

    switched_sink(stream(), F.col("kind"), table, sink, str(tmp_path / "query"), default="rest").awaitTermination()
    assert got == expected([["a", "rest"], ["a", "rest", "b"], ["b"]], "rest")
    assert table.routes() == ["b"] and table.has_route("b") and not table.has_route("a")
    assert RouteTable(spark, str(tmp_path / "table")).routes() == ["b"] and RouteTable(spark, str(tmp_path / "none")).routes() == []


def test_a_batch_that_runs_again_takes_the_same_routes(spark, stream, tmp_path):
    table, seen, failed = RouteTable(spark, str(tmp_path / "table"), ["a"]), {}, []

    def sink(df, number):
        seen.setdefault(number, []).append({r.id: r.route for r in df.collect()})
        if number == 1 and not failed:
            failed.append(1)
            table.remove_route("a")
            table.add_route("c")
            raise RuntimeError("lost after routing")

    def start():
        switched_sink(stream(), F.col("kind"), table, sink, str(tmp_path / "query")).awaitTermination()

    with pytest.raises(Exception, match="lost after routing"):
        start()
    start()
    assert len(seen[1]) == 2 and seen[1][0] == seen[1][1]
    last = {k: v for runs in seen.values() for k, v in runs[-1].items()}
    assert last == expected([["a"], ["a"], ["c"]])
