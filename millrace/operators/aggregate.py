"""Aggregation by count windows, time windows or whichever comes first, and monitoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.envelope import SEQ, TS, from_micros, is_success, micros
from millrace.functions.ordering import with_neighbour

from .flow import batch, number_successes


def _bounds() -> list[Column]:
    return [F.min(TS).alias("start_ts"), F.max(TS).alias("end_ts"), F.count("*").alias("n")]


def by_count(df: DataFrame, size: int, aggregates: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """An emission after every ``size`` successes (of a key), the last one maybe of fewer: ``emission`` from 0, first and last
    time, count and aggregates. State starts anew with each."""
    keys = keys or []
    rows = number_successes(df.filter(is_success()), keys).withColumn("emission", F.floor((F.col("_n") - 1) / size))
    return rows.groupBy(*keys, "emission").agg(*_bounds(), *[a.alias(k) for k, a in aggregates.items()])


def fold_by_count(df: DataFrame, size: int, init: Column, fn: Callable[[Column, Column], Column], columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """An emission after every ``size`` successes with the state of a fold: ``fn`` gets the state (``init`` at first) and a
    success, a struct of ``columns``, in arrival order, and returns the state. Windows are bounded by their size."""
    keys = keys or []
    rows = number_successes(df.filter(is_success()), keys).withColumn("emission", F.floor((F.col("_n") - 1) / size))
    out = rows.groupBy(*keys, "emission").agg(*_bounds(), F.sort_array(F.collect_list(F.struct(TS, SEQ, *columns))).alias("_items"))
    return out.withColumn("state", F.aggregate("_items", init, fn)).drop("_items")


def by_time(df: DataFrame, size: int, aggregates: dict[str, Column], keys: list[str] | None = None, empty: bool = False) -> DataFrame:
    """Successes by time windows of ``size`` microseconds: bounds, count and aggregates. With ``empty``, windows between
    the first and the last (of a key) that hold nothing are there too."""
    us, keys = micros(F.col(TS)), keys or []
    rows = df.filter(is_success()).withColumn("_w", us - F.pmod(us, F.lit(size)))
    out = rows.groupBy(*keys, "_w").agg(F.count("*").alias("n"), *[a.alias(k) for k, a in aggregates.items()])
    if empty:
        # The window after, of each key; from one to the next all are there. A row a window, not one for each success.
        order = Window.partitionBy(*keys).orderBy("_w")
        bounds = out.groupBy(*keys).agg(F.min("_w").alias("_a"), F.max("_w").alias("_b")).filter("_a is not null")
        spine = bounds.select(*keys, F.explode(F.sequence("_a", "_b", F.lit(size))).alias("_w"))
        if keys:
            after = F.coalesce(F.lead("_w").over(order), F.col("_w") + size)
            filled = out.withColumn("_all", F.sequence("_w", after - size, F.lit(size)))
            out = filled.select(*keys, F.col("_w").alias("_own"), "n", *aggregates, F.explode("_all").alias("_w"))
            there = F.col("_own") == F.col("_w")
            out = out.select(*keys, "_w", F.when(there, F.col("n")).otherwise(0).alias("n"), *[F.when(there, F.col(k)).alias(k) for k in aggregates])
        else:
            out = spine.join(out, "_w", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(*keys, from_micros(F.col("_w")).alias("start_ts"), from_micros(F.col("_w") + size).alias("end_ts"), "n", *aggregates)


def by_either(df: DataFrame, size: int, latency: int, aggregates: dict[str, Column], keys: list[str]) -> DataFrame:
    """An emission at ``size`` successes or ``latency`` microseconds after the first one, whichever comes first."""
    rows = batch(df.filter(is_success()), size, latency, keys)
    return rows.groupBy(*keys, (F.col("batch_id") - 1).alias("emission")).agg(*_bounds(), *[a.alias(k) for k, a in aggregates.items()])


def running_state(df: DataFrame, aggregates: dict[str, Column], keys: list[str]) -> DataFrame:
    """Every success with the state of its key so far."""
    w = Window.partitionBy(*keys).orderBy(TS, SEQ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.filter(is_success()).withColumns({k: a.over(w) for k, a in aggregates.items()})


def sum_of(c: str) -> Column:
    """An exact sum of numbers with two decimals."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def statistics_of(c: str) -> dict[str, Column]:
    x = F.col(c)
    return {"total": sum_of(c), "low": F.min(x), "high": F.max(x), "mean": F.round(F.avg(x.cast("decimal(18,2)")).cast("double"), 4),
            "variance": F.round(F.var_pop(x), 2), "deviation": F.round(F.stddev_samp(x), 4)}


def count_by(df: DataFrame, size: int, c: str) -> DataFrame:
    """Counts by time window and value of a column, in long form."""
    return by_time(df, size, {}, keys=[c])


def monitor(df: DataFrame, interval: int, keys: list[str] | None = None) -> DataFrame:
    """By interval: item count, rate (per second), and average, least and greatest latency, the time since the key's row
    before (microseconds). The rows themselves are left as they are."""
    keys = keys or []
    us = micros(F.col(TS))
    rows = df.withColumns({"_us": us, "_w": us - F.pmod(us, F.lit(interval))})
    if keys:
        rows = rows.withColumn("_prev", F.lag("_us").over(Window.partitionBy(*keys).orderBy(TS, SEQ)))
    else:
        rows = with_neighbour(rows, "_us", SEQ, "_prev", after=False)
    rows = rows.withColumn("_latency", F.col("_us") - F.col("_prev"))
    return rows.groupBy("_w").agg(
        F.count("*").alias("item_count"), F.round(F.count("*") / (interval / 1e6), 6).alias("rate"), F.round(F.avg("_latency"), 2).alias("avg_latency"),
        F.min("_latency").alias("min_latency"), F.max("_latency").alias("max_latency")).select(
        from_micros(F.col("_w")).alias("start_ts"), from_micros(F.col("_w") + interval).alias("end_ts"), "item_count", "rate", "avg_latency", "min_latency", "max_latency")


def latency_percentiles(df: DataFrame, keys: list[str], points: tuple[float, ...] = (0.5, 0.95, 0.99), exact: bool = True) -> DataFrame:
    """Percentiles of the time since the key's row before, one row; approximate ones need bounded memory only."""
    w = Window.partitionBy(*keys).orderBy(TS, SEQ)
    rows = df.withColumn("_us", micros(F.col(TS))).withColumn("_latency", F.col("_us") - F.lag("_us").over(w))
    f = F.percentile if exact else F.percentile_approx
    return rows.agg(*[f("_latency", F.lit(p)).alias(f"p{round(p * 100)}") for p in points])
