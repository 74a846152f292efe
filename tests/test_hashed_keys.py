"""Filters on hashed keys read the hash; Spark doesn't spell it out in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.fnv import with_fnv1a_mod


def test_filter_reads_the_hash(spark, capsys):
    rows = with_fnv1a_mod(spark.range(1000).withColumnRenamed("id", "k"), "k", 10, "b")
    some = rows.filter(F.col("b") < 3)
    assert {tuple(r) for r in some.collect()} == {tuple(r) for r in rows.collect() if r.b < 3}
    capsys.readouterr()
    some.explain()
    plan = capsys.readouterr().out
    assert plan.count("435") < 40  # the prime's low part: a few times a byte
