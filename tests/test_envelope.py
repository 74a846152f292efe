from __future__ import annotations

import struct
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import envelope as E
from millrace.functions.fnv import with_fnv1a_mod
from millrace.functions.ordering import numbered
from millrace.sources.files import from_rows, read_table, write_routes, write_split

T0 = datetime(2024, 1, 1)


def fnv(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h


@pytest.fixture(scope="module")
def rows(spark):
    return from_rows(spark, [(1, 10, T0), (2, None, T0), (3, 30, T0)], "id int, v int, at timestamp_ntz", "at", "id", failed=F.col("id") == 3)


def test_the_struct_decides(rows):
    assert [r[0] for r in rows.orderBy("id").select(E.is_error()).collect()] == [False, False, True]


def test_value_or_keeps_null_successes(rows):
    assert [r[0] for r in rows.orderBy("id").select(E.value_or("v", F.lit(-1))).collect()] == [10, None, -1]


def test_value_of_an_error_raises(rows):
    with pytest.raises(Exception, match="value of an error row"):
        rows.select(E.value("v")).collect()


def test_maps_leave_the_other_side_alone(rows):
    out = E.map_error(E.map_value(rows, {"v": F.col("v") + 1}), message=F.lit("other"))
    assert [(r.v, r._err and r._err.message) for r in out.orderBy("id").collect()] == [(11, None), (None, None), (30, "other")]


def test_metadata(rows):
    out = E.with_metadata(E.with_metadata(rows, {"k": F.lit("1"), "": F.lit("x")}), {"k": F.lit("2"), "t": F.lit("no number")})
    n, t, gone = (E.typed_metadata(k, "int") for k in ("k", "t", "gone"))
    r = out.select(E.metadata_keys().alias("keys"), n.alias("n"), t.alias("t"), gone.alias("gone"), E.has_metadata().alias("any")).first()
    assert r.keys == ["k", "t"] and r.any
    assert tuple(r.n) == (2, True, False) and tuple(r.t) == (None, False, True) and tuple(r.gone) == (None, False, False)
    assert not rows.select(E.has_metadata()).first()[0]


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_fnv_of_texts_and_numbers(spark, n):
    texts = ["", "apple", "banana", "héllo", "日本", "x" * 50]
    got = {r.k: r.h for r in spark.createDataFrame([(t,) for t in texts], "k string").transform(with_fnv1a_mod, "k", n, "h").collect()}
    assert got == {t: fnv(t.encode()) % n for t in texts}
    numbers = [0, 1, -1, 255, 1 << 40, -(1 << 63), (1 << 63) - 1]
    got = {r.k: r.h for r in spark.createDataFrame([(t,) for t in numbers], "k long").transform(with_fnv1a_mod, "k", n, "h").collect()}
    assert got == {t: fnv(struct.pack("<q", t)) % n for t in numbers}


def test_fnv_of_doubles(spark):
    numbers = [0.0, -0.0, 1.0, -2.5, 0.1, 1e300, 1e-300, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 3.141592653589793]
    got = [r.h for r in spark.createDataFrame([(i, t) for i, t in enumerate(numbers)], "i int, k double").transform(with_fnv1a_mod, "k", 10_007, "h").orderBy("i").collect()]
    assert got == [fnv(struct.pack("<d", t)) % 10_007 for t in numbers]


def test_numbering_is_global(spark):
    rows = [(i, T0 + timedelta(seconds=(i * 37) % 101 // 2)) for i in range(300)]
    df = numbered(spark.createDataFrame(rows, "id int, at timestamp_ntz"), "at", "id", where=F.col("id") % 3 != 0, ranges=7)
    want = sorted((t, i) for i, t in rows if i % 3)
    got = {r.id: r._n for r in df.collect()}
    assert [got[i] for _, i in want] == list(range(1, len(want) + 1))
    assert all(got[i] is None for i in range(0, 300, 3))
    assert numbered(df.drop("_n").limit(0), "at", "id").count() == 0


def test_sinks(rows, tmp_path, spark):
    write_split(rows, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert read_table(spark, str(tmp_path / "good")).count() == 2 and read_table(spark, str(tmp_path / "bad")).count() == 1
    write_routes(rows.withColumn("route", F.when(F.col("id") > 1, "a").otherwise("b")), str(tmp_path / "routes"))
    assert (tmp_path / "routes" / "route=a").is_dir()
    with pytest.raises(ValueError, match="unknown format"):
        read_table(spark, "x", "xml")
