"""Operators that count rows, on streams: numbers go on from one micro-batch to the next, and from one start of the query to the
next.

Over all rows, a micro-batch is numbered in parallel and begins where the one before ended, by a counter a batch id: a batch
that is run again finds the same one. By key, the state store holds a number, or the rows of a ring buffer.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from millrace.functions.envelope import SEQ, TS, is_error, is_success, micros
from millrace.functions.shipping import ship_package
from millrace.operators.flow import number_successes
from millrace.operators.route import round_robin_by_number

from .stateful import SQ, US, _keyed, _plain, _run

Transform = Callable[[DataFrame], DataFrame]


def numbered_sink(df: DataFrame, transform: Transform, sink: Callable[[DataFrame, int], None], folder: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch, its successes numbered from 1 in ``_n`` since the query first began and in order of arrival within the
    batch, through ``transform`` (such as ``take``) to ``sink``. ``folder`` holds the query's checkpoint and the counters."""
    spark = df.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        before = _counted(spark, folder, number - 1)
        batch = batch.persist()
        try:
            own = batch.filter(is_success()).count()
            spark.createDataFrame([(before + own,)], "total long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/counters/{number}")
            sink(transform(number_successes(batch, []).withColumn("_n", F.col("_n") + before)), number)
        finally:
            batch.unpersist()

    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def _counted(spark: SparkSession, folder: str, number: int) -> int:
    return spark.read.schema("total long").parquet(f"{folder}/counters/{number}").first()[0] if number >= 0 else 0


def take(n: int) -> Transform:
    """The first ``n`` successes of the stream; errors pass uncounted."""
    return lambda rows: rows.filter(is_error() | (F.col("_n") <= n)).drop("_n")


def skip(n: int) -> Transform:
    return lambda rows: rows.filter(is_error() | (F.col("_n") > n)).drop("_n")


def chunk(size: int) -> Transform:
    """``chunk_id`` and ``chunk_place`` from 0; a chunk may go on in the next micro-batch."""
    if size < 1:
        raise ValueError("size must be positive")
    return lambda rows: rows.withColumns({"chunk_id": F.floor((F.col("_n") - 1) / size), "chunk_place": (F.col("_n") - 1) % size}).drop("_n")


def round_robin(n: int, name: str = "partition") -> Transform:
    """Partitions in turn; the next micro-batch goes on with the next one's turn."""
    return lambda rows: round_robin_by_number(rows, n, name)


def _number_step(state, us):
    return (state or 0) + 1, ((state or 0) + 1,)


def _by_key(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return _keyed(df, keys, _number_step, "_n bigint", columns)


def take_by_key(df: DataFrame, n: int, keys: list[str], columns: list[str]) -> DataFrame:
    """The first ``n`` successes of each key (payload columns, ``_seq``, ``_ts``)."""
    return _by_key(df, keys, columns).filter(F.col("_n") <= n).drop("_n")


def skip_by_key(df: DataFrame, n: int, keys: list[str], columns: list[str]) -> DataFrame:
    return _by_key(df, keys, columns).filter(F.col("_n") > n).drop("_n")


def chunk_by_key(df: DataFrame, size: int, keys: list[str], columns: list[str]) -> DataFrame:
    """Successes with the ``chunk_id`` and ``chunk_place`` of their key, from 0."""
    return chunk(size)(_by_key(df, keys, columns))


class _Ring(StatefulProcessor):
    """A key's newest rows, ``size`` at most, in a list state."""

    def __init__(self, size: int, columns: list[str]):
        self.size, self.columns = size, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "row binary")
        self.seen = handle.getValueState("seen", "n bigint")

    def held(self) -> list[tuple]:
        return [pickle.loads(r[0]) for r in self.ring.get()] if self.ring.exists() else []

    def keep(self, rows: list[tuple]) -> None:
        self.ring.put([(pickle.dumps(r),) for r in rows])

    def arrived(self, rows: Iterator[pd.DataFrame]) -> list[tuple]:
        pdf = pd.concat(list(rows)).sort_values([US, SQ])
        return list(zip(*(pdf[c].tolist() for c in self.columns)))

    def close(self) -> None:
        pass


class _Newest(_Ring):
    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = self.arrived(rows)
        seen = (self.seen.get()[0] if self.seen.exists() else 0) + len(new)
        kept = sorted([*self.held(), *new], key=lambda r: (r[self.columns.index(US)], r[self.columns.index(SQ)]))[-self.size :]
        self.seen.update((seen,))
        self.keep(kept)
        yield pd.DataFrame([(*r, seen, max(0, seen - self.size)) for r in kept], columns=[*self.columns, "seen", "dropped_count"])


class _Moving(_Ring):
    def __init__(self, size: int, columns: list[str], at: int, fn: Callable[[list], object], out: str):
        super().__init__(size, columns)
        self.at, self.fn, self.out = at, fn, out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, ring, found = self.arrived(rows), [r[0] for r in self.held()], []
        for r in new:
            ring = [*ring, r[self.at]][-self.size :]
            found.append((*r, self.fn(ring)))
        self.keep([(v,) for v in ring])
        yield pd.DataFrame(found, columns=[*self.columns, self.out])


def _rows(df: DataFrame, columns: list[str]) -> DataFrame:
    ship_package(df.sparkSession)
    return df.filter(is_success()).select(*columns, SEQ, TS, micros(F.col(TS)).alias("_us"))


def dropping_buffer(df: DataFrame, size: int, keys: list[str], columns: list[str]) -> DataFrame:
    """The newest ``size`` successes of each key that a micro-batch has rows of, as they are after it, with ``dropped_count`` and with
    ``seen``, the key's successes so far: the rows of a key's largest ``seen`` are what its buffer holds."""
    rows = _rows(df, columns)
    return _run(rows, keys, _Newest(size, [_plain(c) for c in rows.columns]), StructType.fromDDL("seen bigint, dropped_count bigint"), "None").drop("_us")


def sliding_buffer(df: DataFrame, size: int, value: str, fn: Callable[[list], object], out: str, keys: list[str], columns: list[str]) -> DataFrame:
    """Every success with a value (``out``, a DDL string of one column) of ``fn`` over the last ``size`` values of a column of its key,
    its own included."""
    rows, own = _rows(df, columns), StructType.fromDDL(out)
    names = [_plain(c) for c in rows.columns]
    return _run(rows, keys, _Moving(size, names, names.index(_plain(value)), fn, _plain(own.names[0])), own, "None").drop("_us")
