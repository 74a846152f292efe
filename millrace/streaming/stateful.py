"""The sequential operators on unbounded streams: the same steps as in batch, with each key's state in the state store.

A micro-batch's rows of a key are put in order before they meet the state. Needs the RocksDB state store:
``spark.sql.streaming.stateStore.providerClass``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from millrace.functions.envelope import SEQ, TS, is_error, is_success, micros
from millrace.functions.shipping import ship_package
from millrace.operators.flow import DEFAULT_TTL, batch_step, bucket_step, throttle_step
from millrace.operators.resilience import breaker_step


class _Fold(StatefulProcessor):
    """A step function over the rows of a key, in order; outputs become columns. With ``expire`` (microseconds), the state of
    a key goes once the watermark is that far past its last row."""

    def __init__(self, step: Callable, inputs: list[str], order: list[str], out: list[str], columns: list[str], expire: int | None = None):
        self.step, self.inputs, self.order, self.out, self.columns, self.expire = step, inputs, order, out, columns, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "value binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.order)
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else None
        found = []
        for values in zip(*(pdf[c].tolist() for c in self.inputs)):
            state, result = self.step(state, *values)
            found.append(result)
        self.state.update((pickle.dumps(state),))
        if self.expire is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, (tuple, list)) else t)
            self.handle.registerTimer((int(pdf[US].max()) + self.expire + 999) // 1000)
        pdf[self.out] = pd.DataFrame(found, columns=self.out, index=pdf.index, dtype=object)
        yield pdf[[*self.columns, *self.out]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _plain(c: str) -> str:
    """Column names that begin with an underscore don't reach a processor as they are."""
    return f"x{c}" if c.startswith("_") else c


def _run(df: DataFrame, keys: list[str], processor: StatefulProcessor, out: StructType, time_mode: str) -> DataFrame:
    """``transformWithStateInPandas`` under plain names, and the given names again."""
    rows = df.select(*[F.col(c).alias(_plain(c)) for c in df.columns])
    schema = StructType([*rows.schema.fields, *[StructField(_plain(f.name), f.dataType) for f in out]])
    done = rows.groupBy(*[_plain(k) for k in keys]).transformWithStateInPandas(processor, schema, "Append", time_mode)
    return done.select(*[F.col(_plain(c)).alias(c) for c in (*df.columns, *out.names)])


def stateful_fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], step: Callable, out: str, expire: int | None = None) -> DataFrame:
    """``ordered_fold`` for a stream of rows that all take part. Late rows meet the state as it is. With ``expire``, the stream
    has a watermark on ``_ts`` and ``_us`` among its columns."""
    ship_package(df.sparkSession)
    own = StructType.fromDDL(out)
    names = lambda cs: [_plain(c) for c in cs]
    return _run(df, keys, _Fold(step, names(inputs), names(order), names(own.names), names(df.columns), expire), own, "None" if expire is None else "EventTime")


def _keyed(df: DataFrame, keys: list[str], step: Callable, out: str, columns: list[str], expire: int | None = None, lateness: str | None = None) -> DataFrame:
    rows = df.filter(is_success()).select(*columns, SEQ, TS, micros(F.col(TS)).alias("_us"))
    if lateness is None:
        return stateful_fold(rows, keys, ["_us", SEQ], ["_us"], step, out).drop("_us")
    rows = rows.withColumn(TS, F.col(TS).cast("timestamp")).withWatermark(TS, lateness)
    return stateful_fold(rows, keys, ["_us", SEQ], ["_us"], step, out, expire).drop("_us")


def throttle(df: DataFrame, duration: int, keys: list[str], columns: list[str], lateness: str | None = None) -> DataFrame:
    """Successes that the throttle lets through (payload columns, ``_seq``, ``_ts``). With ``lateness``, a key that has been
    quiet for ``duration`` is forgotten, as it would let the next row through anyway; rows later than that are dropped."""
    return _keyed(df, keys, throttle_step(duration), "_keep boolean", columns, duration, lateness).filter("_keep").drop("_keep")


def dedupe(df: DataFrame, keys: list[str], columns: list[str], ttl: int = DEFAULT_TTL, lateness: str | None = None) -> DataFrame:
    """Successes whose key has not been let through for ``ttl`` microseconds. State as in ``throttle``."""
    return throttle(df, ttl, keys, columns, lateness)


def token_bucket(df: DataFrame, interval: int, burst: int, keys: list[str], columns: list[str]) -> DataFrame:
    return _keyed(df, keys, bucket_step(interval, burst), "_keep boolean", columns).filter("_keep").drop("_keep")


def batch(df: DataFrame, max_size: int, latency: int, keys: list[str], columns: list[str]) -> DataFrame:
    """Successes with the ``batch_id`` of their key."""
    return _keyed(df, keys, batch_step(max(1, max_size), latency), "batch_id bigint", columns)


def count_fold_step(size: int, init: object, fn: Callable):
    """State of a fold that starts anew after ``size`` rows; the row that completes it gets the emission and the state."""

    def step(state, *values):
        emission, n, acc = state or (0, 0, init)
        acc, n = fn(acc, *values), n + 1
        return ((emission + 1, 0, init), (emission, acc)) if n >= size else ((emission, n, acc), (None, None))

    return step


def fold_by_count(df: DataFrame, size: int, init: object, fn: Callable, inputs: list[str], kind: str, keys: list[str]) -> DataFrame:
    """An emission after every ``size`` successes of a key, with the time of its last row: ``emission`` from 0 and ``state`` (of
    DDL type ``kind``), the fold of ``fn(state, *inputs)`` from ``init``. An emission that is not full waits."""
    rows = df.filter(is_success()).select(*dict.fromkeys([*keys, *inputs]), SEQ, TS, micros(F.col(TS)).alias("_us"))
    out = stateful_fold(rows, keys, ["_us", SEQ], inputs, count_fold_step(size, init, fn), f"emission bigint, state {kind}")
    return out.filter("emission is not null").select(*keys, F.col(TS).alias("end_ts"), "emission", "state")


def _latency_step(last, us):
    return us, (None if last is None else us - last,)


def latencies(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """All rows with ``latency``, the microseconds since the key's row before: what a monitor averages by interval."""
    rows = df.select(*columns, SEQ, TS, micros(F.col(TS)).alias("_us"))
    return stateful_fold(rows, keys, ["_us", SEQ], ["_us"], _latency_step, "latency bigint").drop("_us")


def circuit_breaker(df: DataFrame, keys: list[str], columns: list[str], rate: float = 0.5, least: int = 10, pause: int = 30_000_000, probes: int = 3) -> DataFrame:
    """All rows, errors counting as failures, with ``outcome`` and ``circuit``."""
    rows = df.select(*columns, SEQ, TS, micros(F.col(TS)).alias("_us"), is_error().alias("_failed"))
    out = stateful_fold(rows, keys, ["_us", SEQ], ["_us", "_failed"], breaker_step(rate, least, pause, probes), "outcome string, circuit string")
    return out.drop("_us", "_failed")


US, SQ = _plain("_us"), _plain(SEQ)


class _Debounce(StatefulProcessor):
    """Holds a key's last row until the watermark is ``duration`` past it."""

    def __init__(self, duration: int, columns: list[str]):
        self.duration, self.columns = duration, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "value binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values([US, SQ])
        if self.pending.exists():
            pdf = pd.concat([pd.DataFrame([pickle.loads(self.pending.get()[0])]).astype(pdf.dtypes), pdf]).sort_values([US, SQ])
        us = pdf[US].tolist()
        quiet = [b - a >= self.duration for a, b in zip(us, us[1:])] + [False]
        self.pending.update((pickle.dumps(pdf.iloc[-1].to_dict()),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, (tuple, list)) else t)
        self.handle.registerTimer((us[-1] + self.duration + 999) // 1000)
        yield pdf[quiet][self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.pending.exists():
            row = pickle.loads(self.pending.get()[0])
            self.pending.clear()
            yield pd.DataFrame([row])[self.columns]

    def close(self) -> None:
        pass


def debounce(df: DataFrame, duration: int, keys: list[str], columns: list[str], lateness: str = "0 seconds") -> DataFrame:
    """Successes followed by ``duration`` microseconds of quiet on their key. A key's last row comes once the watermark is
    that far past it, so a bounded replay needs a closing row with a later time."""
    ship_package(df.sparkSession)
    rows = df.filter(is_success()).select(*columns, SEQ, F.col(TS).cast("timestamp").alias(TS), micros(F.col(TS)).alias("_us")).withWatermark(TS, lateness)
    out = _run(rows, keys, _Debounce(duration, [_plain(c) for c in rows.columns]), StructType([]), "EventTime")
    return out.drop("_us")
