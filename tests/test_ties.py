"""Rows that an ORDER BY leaves tied come as they stand in the files, as they do in the SQL's engine."""

from __future__ import annotations

import datetime

import duckdb

from millrace.plans import catalogue


def test_tied_lines_are_batched_in_the_order_of_the_files(spark, tmp_path):
    """Lines equal in date and number over a small file and a larger one, which Spark reads first."""
    day = datetime.datetime(1996, 1, 1)
    schema = "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_shipdate timestamp_ntz"
    folder = tmp_path / "lineitem.parquet"
    rows = [(i // 500, 1, float(i), 0.05 * (i % 2), "A", day) for i in range(3000)]
    for n, part in enumerate((rows[:250], rows[250:])):
        made = spark.createDataFrame(part, schema).coalesce(1)
        made.write.parquet(str(tmp_path / f"made-{n}"))
        folder.mkdir(exist_ok=True)
        next((tmp_path / f"made-{n}").glob("*.parquet")).rename(folder / f"part-{n}.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    columns = ["side", "l_returnflag", "emission", "n", "quantity"]
    found = catalogue.queries()["pipe_quality"](spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(tuple, found)) == sorted(db.execute(catalogue.oracle_sql()["pipe_quality"]).fetchall())
    assert len(found) == 30
