"""Retries that really wait: a row that failed stays in the state store and comes back by a timer, in a later micro-batch."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from millrace.functions.envelope import SEQ, TS, is_success, micros
from millrace.functions.shipping import ship_package
from millrace.operators.resilience import wait_before

from .stateful import SQ, US, _plain, _run

RESULTS = ["result", "attempts", "failure", "waited"]


class _Retry(StatefulProcessor):
    """Rows that wait, each with its attempts, its waits so far and the time at which it is due."""

    def __init__(self, attempt: Callable, most_attempts: int, again: Callable | None, base: int, most: int, columns: dict[str, str], names: list[str]):
        self.attempt, self.most_attempts, self.again, self.base, self.most, self.columns, self.names = attempt, most_attempts, again, base, most, columns, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "row binary")

    def on(self, row: dict, n: int, waited: int, due: int, now: int | None) -> tuple[tuple | None, tuple | None]:
        """What a row comes to: its result, or the row as it waits. Attempts that are due by ``now`` are made at once."""
        while True:
            n += 1
            try:
                return (self.attempt({c: row[p] for c, p in self.columns.items()}, n), n, None, waited), None
            except Exception as e:
                failure = str(e)
            if n >= self.most_attempts or (self.again is not None and not self.again(failure, n)):
                return (None, n, failure, waited), None
            wait = wait_before(row[SQ], n + 1, self.base, self.most)
            waited, due = waited + wait, due + wait
            if now is None or due > now:
                return None, (row, n, waited, due)

    def go(self, rows: list[tuple], held: list[tuple], now: int | None) -> Iterator[pd.DataFrame]:
        found = []
        for row, *state in rows:
            result, waits = self.on(row, *state, now)
            if waits is None:
                found.append((*(row[c] for c in self.names), *result))
            else:
                held.append(waits)
        self.waiting.clear()
        if held:
            self.waiting.put([(pickle.dumps(r),) for r in held])
            self.handle.registerTimer(-(-min(r[3] for r in held) // 1000))
        if found:
            yield pd.DataFrame(found, columns=[*self.names, *RESULTS], dtype=object)

    def held(self) -> list[tuple]:
        return [pickle.loads(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values([US, SQ])
        new = [(r, 0, 0, int(r[US])) for r in (dict(zip(self.names, v)) for v in zip(*(pdf[c].tolist() for c in self.names)))]
        return self.go(new, self.held(), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.held()
        return self.go([r for r in held if r[3] <= now], [r for r in held if r[3] > now], now)

    def close(self) -> None:
        pass


def retry(df: DataFrame, attempt: Callable[[dict, int], object], kind: str, keys: list[str], columns: list[str], max_attempts: int = 3, again: Callable[[str, int], bool] | None = None,
          base: int = 100_000, most: int = 30_000_000, lateness: str = "0 seconds") -> DataFrame:
    """What the batch form gives of each success (``columns``, ``_seq``, ``_ts``, ``result``, ``attempts``, ``failure``, ``waited``), once it has
    returned or is given up. A row's first attempt is made when it comes, each further one when the watermark has passed its
    wait, so the stream's own time is what it waits by. ``keys`` deal the rows that wait; take ones with many values. Attempts may
    be made again after a failure of the query, results come once: what follows takes each row of a micro-batch once,
    as Spark's file sinks do. Split by ``failure`` for dead letters."""
    ship_package(df.sparkSession)
    rows = df.filter(is_success()).select(*columns, SEQ, F.col(TS).cast("timestamp").alias(TS), micros(F.col(TS)).alias("_us")).withWatermark(TS, lateness)
    names = [_plain(c) for c in rows.columns]
    out = StructType.fromDDL(f"result {kind}, attempts int, failure string, waited bigint")
    return _run(rows, keys, _Retry(attempt, max_attempts, again, base, most, {c: _plain(c) for c in columns}, names), out, "EventTime").drop("_us")
