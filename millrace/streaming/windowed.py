"""Windows on streams that Spark's own window function doesn't have: sliding ones counted from a key's first row, sessions of
limited duration, and time windows with the empty ones between them.

Every operator gives what its batch form gives, whatever the order in which rows come, as long as none is later than the
watermark: results come by event-time timers, once the watermark has passed what they depend on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import gcd

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from millrace.functions.envelope import TS, WINDOW_END, WINDOW_START, from_micros, is_error, is_success, micros
from millrace.functions.shipping import ship_package

#: How values of rows, or of panes, become one.
MERGES: dict[str, Callable] = {"sum": lambda a, b: a if b is None else b if a is None else a + b, "min": lambda a, b: a if b is None else b if a is None else min(a, b),
                               "max": lambda a, b: a if b is None else b if a is None else max(a, b)}
Measures = dict[str, tuple[str, str]]


def _merged(a: tuple, b: tuple, hows: list[str]) -> tuple:
    """Counts (all, successes) and measures of two sets of rows."""
    return (a[0] + b[0], a[1] + b[1], *(MERGES[h](x, y) for h, x, y in zip(hows, a[2:], b[2:])))


class _Windows(StatefulProcessor):
    """Counts and measures of panes in the state store, and timers at the ends of windows."""

    def __init__(self, keys: list[str], measures: Measures, kinds: list[str]):
        self.keys, self.hows, self.columns, self.kinds = keys, [h for h, _ in measures.values()], [f"m{i}" for i in range(len(measures))], kinds
        self.value = ", ".join(["n bigint", "good bigint", *(f"m{i} {k}" for i, k in enumerate(kinds))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "pane bigint", self.value)
        self.open = handle.getMapState("windows", "start bigint", "ends bigint")
        self.first = handle.getValueState("first", "us bigint")
        self.held = handle.getListState("held", f"us bigint, {self.value}")

    def rows_of(self, rows: Iterator[pd.DataFrame]) -> list[tuple]:
        """``(microseconds, one, success, measures)`` of each row."""
        pdf = pd.concat(list(rows))
        flags = [f"h{c[1:]}" for c in self.columns]
        k = len(flags)
        return [(int(us), 1, int(not bad), *(x if there else None for x, there in zip(m[:k], m[k:]))) for us, bad, *m in zip(*(pdf[c].tolist() for c in ("us", "bad", *self.columns, *flags)))]

    def add(self, pane: int, value: tuple) -> None:
        old = self.panes.getValue((pane,)) if self.panes.containsKey((pane,)) else None
        self.panes.updateValue((pane,), value if old is None else _merged(tuple(old), value, self.hows))

    def frame(self, key: tuple, found: list[tuple]) -> pd.DataFrame:
        names = [*self.keys, "starts", "ends", "n", "good", *self.columns]
        return pd.DataFrame([(*key, *f) for f in found], columns=names).astype(object)

    def nothing(self) -> tuple:
        return (0, 0, *[None] * len(self.columns))

    def close(self) -> None:
        pass


class _Sliding(_Windows):
    def __init__(self, size: int, slide: int, *rest):
        super().__init__(*rest)
        self.size, self.slide, self.pane = size, slide, gcd(size, slide)

    def place(self, anchor: int, row: tuple) -> None:
        self.add((row[0] - anchor) // self.pane, row[1:])
        start = anchor + (row[0] - anchor) // self.slide * self.slide
        if not self.open.containsKey((start,)):
            self.open.updateValue((start,), (start + self.size,))
            self.handle.registerTimer(-(-(start + self.size) // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = self.rows_of(rows)
        if self.first.exists():
            anchor = self.first.get()[0]
            for row in new:
                self.place(anchor, row)
        else:  # until the watermark has passed it, an earlier row may be the first
            self.held.appendList(new)
            self.handle.registerTimer(-(-min(r[0] for r in new) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        if not self.first.exists():
            held = [tuple(r) for r in self.held.get()]
            if not held or min(r[0] for r in held) > passed:
                return
            self.first.update((min(r[0] for r in held),))
            self.held.clear()
            for row in held:
                self.place(self.first.get()[0], row)
        anchor = self.first.get()[0]
        panes = {p[0]: tuple(v) for p, v in self.panes.iterator()}
        windows = {s[0]: e[0] for s, e in self.open.iterator()}
        found = []
        for start in sorted(s for s, end in windows.items() if end <= passed):
            total, at = self.nothing(), (start - anchor) // self.pane
            for p in range(at, at + self.size // self.pane):
                if p in panes:
                    total = _merged(total, panes[p], self.hows)
            found.append((start, start + self.size, *total))
            self.open.removeKey((start,))
        # A window that is open, or opens with a row to come, needs panes from its start on.
        needed = min([s for s, end in windows.items() if end > passed] + [anchor + (passed - anchor) // self.slide * self.slide])
        for p in panes:
            if anchor + p * self.pane < needed:
                self.panes.removeKey((p,))
        if found:
            yield self.frame(key, found)


class _Gapless(_Windows):
    """Windows from the epoch; ``quiet``: after how many empty ones in a row a key is forgotten, which come as time passes; without
    one, empty windows come with the next one that is not."""

    def __init__(self, size: int, quiet: int | None, *rest):
        super().__init__(*rest)
        self.size, self.quiet = size, quiet

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for us, *value in self.rows_of(rows):
            start = us // self.size * self.size
            if not self.panes.containsKey((start,)):
                self.handle.registerTimer(-(-(start + self.size) // 1000))
            self.add(start, tuple(value))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        there = {p[0]: tuple(v) for p, v in self.panes.iterator()}
        at = self.first.get()[0] if self.first.exists() else min(there, default=None)  # the first window that has not come
        if at is None:
            return
        full = self.open.getValue((0,))[0] if self.open.containsKey((0,)) else at  # the last one that wasn't empty
        last = max((w for w in there if w + self.size <= passed), default=None)
        found = []
        while at + self.size <= passed:
            if at in there:
                found.append((at, at + self.size, *there.pop(at)))
                self.panes.removeKey((at,))
                full = at
            elif self.quiet is not None and at - full > self.quiet * self.size:
                if not there:
                    at = None
                    break
                at = min(there)
                continue
            elif self.quiet is None and (last is None or at > last):
                break
            else:
                found.append((at, at + self.size, *self.nothing()))
            at += self.size
        if at is None:
            for s in (self.first, self.panes, self.open):
                s.clear()
        else:
            self.first.update((at,))
            self.open.updateValue((0,), (full,))
            if self.quiet is not None:
                self.handle.registerTimer(-(-(at + self.size) // 1000))
        if found:
            yield self.frame(key, found)


class _Sessions(_Windows):
    """Rows wait until the watermark has passed them, and then meet the open session in order of time."""

    def __init__(self, gap: int, most: int, *rest):
        super().__init__(*rest)
        self.gap, self.most = gap, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.session = handle.getValueState("session", f"starts bigint, last bigint, {self.value}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = self.rows_of(rows)
        self.held.appendList(new)
        self.handle.registerTimer(min(r[0] for r in new) // 1000 + 1)
        return iter(())

    def ended(self, s: tuple) -> tuple:
        return (s[0], min(s[1] + self.gap, s[0] + self.most), *s[2:])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((tuple(r) for r in self.held.get()), key=lambda r: r[0])
        open_ = tuple(self.session.get()) if self.session.exists() else None
        found = []
        for us, *value in (r for r in held if r[0] < passed):
            if open_ is not None and (us - open_[1] > self.gap or us - open_[0] >= self.most):
                found.append(self.ended(open_))
                open_ = None
            open_ = (us, us, *value) if open_ is None else (open_[0], us, *_merged(open_[2:], tuple(value), self.hows))
        wait = [r for r in held if r[0] >= passed]
        self.held.clear()
        if wait:
            self.held.appendList(wait)
        if open_ is not None and (passed > open_[1] + self.gap or passed >= open_[0] + self.most):
            found.append(self.ended(open_))
            open_ = None
        if open_ is None:
            self.session.clear()
        else:
            self.session.update(open_)
        # Both ends of the open session, and the first row that waits.
        ends = [] if open_ is None else [(open_[1] + self.gap) // 1000 + 1, -(-(open_[0] + self.most) // 1000)]
        for t in {min(ends)} if ends else set():
            self.handle.registerTimer(t)
        if wait:
            self.handle.registerTimer(wait[0][0] // 1000 + 1)
        if found:
            yield self.frame(key, found)


def _run(df: DataFrame, keys: list[str], measures: Measures, lateness: str, processor: Callable) -> DataFrame:
    """Keys, bounds, counts and measures, as the processor emits them."""
    ship_package(df.sparkSession)
    own = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    values = [(f"{i}", F.when(is_success(), F.col(c))) for i, (_, c) in enumerate(measures.values())]  # nulls as flags: pandas would make whole numbers doubles
    rows = df.select(*own, F.col(TS).cast("timestamp").alias("at"), micros(F.col(TS)).alias("us"), is_error().alias("bad"), *[F.coalesce(v, F.lit(0).cast(df.schema[c].dataType)).alias(f"m{i}") for (i, v), (_, c) in zip(values, measures.values())],
                     *[v.isNotNull().alias(f"h{i}") for i, v in values])
    rows = rows.filter("us is not null").withWatermark("at", lateness)
    names = [f"k{i}" for i in range(len(keys))]
    kinds = [rows.schema[f"m{i}"].dataType for i in range(len(measures))]
    for how, kind in zip((h for h, _ in measures.values()), kinds):
        if how not in MERGES or kind.simpleString() not in ("bigint", "int", "double"):
            raise ValueError(f"can't keep the {how} of {kind.simpleString()}: sum, min and max of numbers only")
    numbers = StructType.fromDDL("starts bigint, ends bigint, n bigint, good bigint").fields
    schema = StructType([*(rows.schema[k] for k in names), *numbers, *(StructField(f"m{i}", k) for i, k in enumerate(kinds))])
    made = processor(names, measures, [k.simpleString() for k in kinds])
    out = rows.groupBy(*names).transformWithStateInPandas(made, schema, "Append", "EventTime")
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], from_micros(F.col("starts")).alias(WINDOW_START), from_micros(F.col("ends")).alias(WINDOW_END),
                      F.col("n").alias("item_count"), F.col("good").alias("success_count"), (F.col("n") - F.col("good")).alias("error_count"), *[F.col(f"m{i}").alias(k) for i, k in enumerate(measures)])


def sliding_anchored(df: DataFrame, size: int, slide: int, keys: list[str], lateness: str = "0 seconds", measures: Measures | None = None) -> DataFrame:
    """Collected sliding windows of each key, counted from the key's first row, that open with a row in their first slide; each
    comes once the watermark has passed its end. ``measures``: name to (sum, min or max, column) over successes. The state of
    a key is its panes since the start of its earliest open window, a row for each that holds something."""
    if not 0 < slide <= size:
        raise ValueError("a slide must be positive and no longer than the size")
    return _run(df, keys, measures or {}, lateness, lambda *a: _Sliding(size, slide, *a))


def session_capped(df: DataFrame, keys: list[str], gap: int, most: int, lateness: str = "0 seconds", measures: Measures | None = None) -> DataFrame:
    """Collected sessions of each key that close after ``gap`` microseconds without a row, or ``most`` after their first row."""
    if gap <= 0 or most <= 0:
        raise ValueError("the gap and the longest duration must be positive")
    return _run(df, keys, measures or {}, lateness, lambda *a: _Sessions(gap, most, *a))


def by_time_gapless(df: DataFrame, size: int, keys: list[str], lateness: str = "0 seconds", measures: Measures | None = None, quiet: int | None = None) -> DataFrame:
    """Time windows of each key's successes, and the empty ones between its first and its last: ``start_ts, end_ts, n`` and measures.
    An empty window comes with the next one that isn't; with ``quiet``, when the watermark passes its end, until so many have
    come in a row: then the key is forgotten, and begins anew with its next row."""
    if size <= 0 or (quiet is not None and quiet < 0):
        raise ValueError("the size must be positive")
    out = _run(df.filter(is_success()), keys, measures or {}, lateness, lambda *a: _Gapless(size, quiet, *a))
    return out.select(*keys, F.col(WINDOW_START).alias("start_ts"), F.col(WINDOW_END).alias("end_ts"), F.col("item_count").alias("n"), *(measures or {}))
