"""Retries over micro-batches and a restart give what the batch form gives, each row once."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.functions.envelope import wrap
from millrace.operators import resilience as S
from millrace.sources.files import read_stream
from millrace.streaming import retrying

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, at timestamp_ntz, key long, bad boolean"


def test_retries_wait_in_the_state(spark, tmp_path):
    def flaky(row, n):
        if row["id"] % 6 >= n:
            raise ValueError("hopeless" if row["id"] % 6 == 5 else f"try {n}")
        return row["id"] * n

    rows = [(i, T0 + timedelta(milliseconds=20 * i), i % 3, i % 10 == 9) for i in range(120)]
    parts = [rows[:40], rows[40:80], [*rows[80:], (10**6, datetime(2030, 1, 1), -1, False)]]
    path, seen = str(tmp_path / "in"), []
    options = {"max_attempts": 4, "again": lambda m, n: m != "hopeless", "base": 100_000, "most": 250_000}
    for group in (parts[:2], parts[2:]):
        for p in group:
            spark.createDataFrame(p, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = wrap(read_stream(spark, path, SCHEMA, files_per_trigger=1), "at", "id", failed=F.col("bad"))
        out = retrying.retry(stream, flaky, "bigint", ["key"], ["id", "key"], **options)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        seen.append(spark.read.parquet(str(tmp_path / "out")).count())
    columns = ["id", "result", "attempts", "failure", "waited"]
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).filter("key >= 0").select(columns).collect()]
    batch = wrap(spark.createDataFrame(rows, SCHEMA), "at", "id", failed=F.col("bad"))
    want = [tuple(r) for r in S.retry(batch, flaky, "bigint", **options).filter("attempts is not null").select(columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len({r[0] for r in got}) == len(got) == 108
    assert 30 < seen[0] < 72  # some rows of the first two micro-batches waited over the restart
    assert {r[3] for r in got} == {None, "try 4", "hopeless"}
