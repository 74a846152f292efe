"""Greedy sequential state, for what window functions can't express: each decision depends on the last accepted row.

Rows are dealt by key and sorted in their partition; one pass over Arrow batches carries a small state from row to
row. Nothing is collected: memory does not depend on how many rows a key has. Where a decision depends on the time and
number of rows since the last accepted one only, ``segmented`` jumps from one to the next, and a key with very many rows, or all
rows where there are no keys, is cut into ranges that are worked on side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .ordering import LEAST, cut_points, estimated_bytes, range_of
from .shipping import ship_package


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], step: Callable, out: str, active: str | None = None) -> DataFrame:
    """``df`` with the columns ``out`` (a DDL string), in the order of each key.

    ``step(state, *inputs)`` returns ``(state, outputs)`` and starts from None at every key. Rows whose ``active`` column
    is not true get null outputs and leave the state alone. Without keys all rows form one sequence, in one task.
    """
    spark = df.sparkSession
    ship_package(spark)
    own = StructType.fromDDL(out)
    schema = StructType([*df.schema.fields, *own.fields])
    dealt = df.repartition(*[F.col(k) for k in keys]) if keys else df.repartition(1)
    dealt = dealt.sortWithinPartitions(*keys, *order)
    width = len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        types = [pa.int32() if f.dataType.simpleString() == "int" else pa.int64() if f.dataType.simpleString() == "bigint" else pa.bool_() if f.dataType.simpleString() == "boolean" else pa.string() for f in own]
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
            key = list(zip(*map(col, keys))) if keys else [()] * batch.num_rows
            values = list(zip(*map(col, inputs))) if inputs else [()] * batch.num_rows
            on = col(active) if active else None
            found: list[list] = [[] for _ in range(width)]
            for i, k in enumerate(key):
                if k != at:
                    at, state = k, None
                result = (None,) * width
                if on is None or on[i]:
                    state, result = step(state, *values[i])
                for c, v in zip(found, result):
                    c.append(v)
            arrays = [*batch.columns, *(pa.array(c, t) for c, t in zip(found, types))]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return dealt.mapInArrow(run, schema)


def block_fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], block: Callable, out: str, active: str | None = None) -> DataFrame:
    """``ordered_fold`` with a function of arrays: ``block(state, *inputs)`` gets the next rows of a key, as many as there are in the
    batch, and returns ``(state, outputs)``, an array for each column of ``out``. Inputs are whole numbers or booleans without nulls."""
    ship_package(df.sparkSession)
    own = StructType.fromDDL(out)
    schema = StructType([*df.schema.fields, *own.fields])
    dealt = (df.repartition(*[F.col(k) for k in keys]) if keys else df.repartition(1)).sortWithinPartitions(*keys, *order)
    types = [{"boolean": pa.bool_(), "string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[f.dataType.simpleString()] for f in own]
    kinds = [{"boolean": bool, "string": object}.get(f.dataType.simpleString(), np.int64) for f in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            news, key_of = _blocks(batch, keys)
            values = [np.asarray(col(c)) for c in inputs]
            on = np.asarray(col(active).fill_null(False)) if active else np.ones(n, bool)
            found = [np.zeros(n, k) for k in kinds]
            for a, b in zip([0, *news.tolist()], [*news.tolist(), n]):
                if a or at is None or key_of(0) != at:
                    state = None
                where = a + np.flatnonzero(on[a:b])
                if len(where):
                    state, results = block(state, *(v[where] for v in values))
                    for f, r in zip(found, results):
                        f[where] = r
            at = key_of(n - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(f, t, mask=~on) for f, t in zip(found, types))], names=[f.name for f in schema])

    return dealt.mapInArrow(run, schema)


#: Keys whose segments are found one after the other rather than a step of all at once.
FEW = 16
#: Estimated size below which no key is too much for a task, and beyond which a share of the rows is looked at for such keys.
MIN_BYTES, SAMPLED = 64 << 20, 0.02


def next_starts(us: np.ndarray, wait: int, size: int, gap: int, broken: np.ndarray) -> np.ndarray:
    """For each of ordered times, the place of the segment after the one that would start there: ``size`` rows on, the first row
    ``wait`` after it, or the first row more than ``gap`` after the one before it (0: no such rule), whichever comes first; the
    number of rows if none does. ``broken``: places that start a segment whatever the rules, besides gaps."""
    n = len(us)
    after = np.searchsorted(us, us + wait, "left") if wait else np.full(n, n, np.int64)
    if size:
        after = np.minimum(after, np.arange(size, n + size))
    if gap or len(broken):
        late = np.flatnonzero(np.diff(us) > gap) + 1 if gap else np.zeros(0, np.int64)
        ends = np.append(np.union1d(late, broken), n)
        after = np.minimum(after, ends[np.searchsorted(ends, np.arange(n), "right")])
    return after


def segment_starts(us: np.ndarray, news: np.ndarray, wait: int, size: int, gap: int, state: tuple[int, int, int, int]) -> tuple[np.ndarray, tuple[int, int, int, int]]:
    """Whether each row starts a segment, for the ordered times of several keys that begin at the places ``news``, and the state
    of the last key: its open segment's number (from 1), rows so far and first time, and its last time. ``state`` is that of
    what comes before the first row, if its key does (number 0: nothing does)."""
    n = len(us)
    starts = np.zeros(n, bool)
    number, count, first, last = state
    keys = np.append(0, news) if not len(news) or news[0] else news
    goes_on = bool(number) and keys is not news
    at = keys
    if goes_on:
        end = int(news[0]) if len(news) else n
        entry = min(end, int(np.searchsorted(us[:end], first + wait, "left")) if wait else end, size - count if size else end)
        if gap:
            late = np.flatnonzero(np.diff(us[:end], prepend=last) > gap)
            entry = min(entry, int(late[0]) if len(late) else end)
        at = np.append([entry] if entry < end else np.zeros(0, np.int64), news).astype(np.int64)
    # Keys side by side on one axis, so far apart that no rule reaches from one to the next.
    sizes = np.diff(np.append(keys, n))
    begin = us[keys]
    span = int((us[np.append(keys[1:], n) - 1] - begin).max()) + max(wait, gap) + 2
    if span * len(keys) >= 2**62:
        half = keys[len(keys) // 2] if len(keys) > 1 else 0
        if half:
            left, middle = segment_starts(us[:half], news[news < half], wait, size, gap, state)
            right, after = segment_starts(us[half:], news[news >= half] - half, wait, size, gap, (0, 0, 0, 0))
            return np.append(left, right), after
    axis = us - np.repeat(begin - span * np.arange(len(keys), dtype=np.int64), sizes)
    after = next_starts(axis, wait, size, gap, keys)
    while len(at) > FEW:  # a step of all keys at once
        starts[at] = True
        at = after[at]
        at = at[at < n]
    if len(at):
        places, jump = [], after.tolist()
        for i in at.tolist():
            while i < n:
                places.append(i)
                i = jump[i]
        starts[places] = True
    mine = np.flatnonzero(starts[keys[-1] :]) + keys[-1]
    before = state if goes_on and len(keys) == 1 else (0, 0, 0, 0)
    if len(mine):
        return starts, (before[0] + len(mine), n - int(mine[-1]), int(us[mine[-1]]), int(us[-1]))
    return starts, (before[0], before[1] + n, before[2], int(us[-1]))


class Chain:
    """What a key's rows of one range do to whatever comes before them: from each row at which a segment may start first, the
    open segment at the end, and how many have started. Rows with the same answer in a row are one entry, and what meets stays
    together, so that there are few."""

    def __init__(self, wait: int, size: int, gap: int):
        self.wait, self.size, self.gap = wait, size, gap
        self.n, self.begin, self.last, self.open = 0, 0, 0, True
        self.place, self.time, self.first, self.count, self.starts = (np.zeros(0, np.int64) for _ in range(5))

    def add(self, us: np.ndarray) -> None:
        m = len(us)
        if not self.n:
            self.begin = int(us[0])
        late = np.diff(us, prepend=self.last if self.n else us[0]) > self.gap if self.gap else np.zeros(m, bool)
        breaks = np.append(np.flatnonzero(late), m)
        after = next_starts(us, self.wait, self.size, self.gap, np.zeros(0, np.int64))
        # Pointer doubling: the last start that a chain from each row reaches here, and its number of starts.
        jump, end, steps = np.append(after, m), np.arange(m + 1), np.append(np.ones(m, np.int64), 0)
        while (jump < m).any():
            end = np.where(jump < m, end[jump], end)
            steps = steps + steps[jump]
            jump = jump[jump]
        entry = np.minimum(np.searchsorted(us, self.first + self.wait, "left") if self.wait else m, breaks[0])
        if self.size:
            entry = np.minimum(entry, self.size - self.count)
        entry = np.minimum(entry, m)
        on = entry < m
        e = np.where(on, entry, 0)
        self.first = np.where(on, us[end[e]], self.first)
        self.count = np.where(on, m - end[e], self.count + m)
        self.starts = self.starts + np.where(on, steps[e], 0)
        if self.open:
            places = self.n + np.arange(m)
            over = ((us >= self.begin + self.wait) if self.wait else np.zeros(m, bool)) | (late & (places > 0))
            if self.size:
                over |= places == self.size - 1
            stop = int(np.argmax(over)) + 1 if over.any() else m
            self.open = not over.any()
            times = us[:stop].copy()
            if late[stop - 1] and places[stop - 1]:
                times[-1] = np.iinfo(np.int64).max  # nothing goes on past a gap
            new = end[:stop]
            self.place, self.time = np.append(self.place, places[:stop]), np.append(self.time, times)
            self.first, self.count, self.starts = np.append(self.first, us[new]), np.append(self.count, m - new), np.append(self.starts, steps[:stop])
        same = (np.diff(self.first) == 0) & (np.diff(self.count) == 0) & (np.diff(self.starts) == 0)
        keep = np.append(~same, True)
        self.place, self.time, self.first, self.count, self.starts = (x[keep] for x in (self.place, self.time, self.first, self.count, self.starts))
        self.n, self.last = self.n + m, int(us[-1])


CHAIN = "_n bigint, _begin bigint, _last bigint, _place bigint, _time bigint, _first bigint, _count bigint, _starts bigint"


def follow(state: tuple[int, int, int, int], chain: np.ndarray, wait: int, size: int, gap: int) -> tuple[int, int, int, int]:
    """The state after a range, given that before it and the range's chain: columns as in ``CHAIN``, rows by place."""
    number, count, first, last = state
    n, begin, end = (int(x) for x in chain[:3, 0])
    at = len(chain[0])
    if not number or (gap and begin - last > gap):
        at = 0
    else:
        if wait or gap:
            at = int(np.searchsorted(chain[4], first + wait if wait else np.iinfo(np.int64).max, "left"))
        if size:
            at = min(at, int(np.searchsorted(chain[3], size - count, "left")))
    if at >= len(chain[0]):
        return number, count + n, first, end
    return number + int(chain[7, at]), int(chain[6, at]), int(chain[5, at]), end


def _plain(key: tuple) -> tuple:
    return tuple("NaN" if isinstance(x, float) and x != x else x for x in key)


def _blocks(batch: pa.RecordBatch, keys: list[str]) -> tuple[np.ndarray, Callable[[int], tuple]]:
    """Places at which another key begins, and the key of a row."""
    new = np.zeros(batch.num_rows, bool)
    columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
    for c in columns:
        code = np.asarray(pc.fill_null(c.dictionary_encode().indices, -1))
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new), lambda i: _plain(tuple(c[i].as_py() for c in columns))


def _ranges(df: DataFrame, keys: list[str], us: str, tie: str, ranges: int) -> tuple[DataFrame, bool]:
    """``df`` with ``_range``: which piece of its key a row is in, for keys that fill more than a range; -1 for others. And
    whether there are such keys. They are looked for in a sample, which bears on where rows are worked on and on nothing else."""
    whole = df.schema[tie].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    named = df.withColumns({"_h": F.xxhash64(*keys).bitwiseAND((1 << 52) - 1) if keys else F.lit(0).cast("long"), "_u": F.coalesce(us, F.lit(0)), "_q": F.coalesce(F.col(tie).cast("long"), F.lit(LEAST)) if whole else F.lit(0).cast("long")})
    columns = ["_h", "_u", "_q"] if keys else ["_u", "_q"]
    narrow = named.select(*columns)
    narrow = narrow.sample(SAMPLED, seed=1) if estimated_bytes(narrow) > MIN_BYTES else narrow
    bounds, full = cut_points(narrow, columns, ranges, deeper=1 if keys else 0)
    if not (full if keys else bounds):
        return df.withColumn("_range", F.lit(-1)), False
    place = range_of(bounds, columns)
    return named.withColumn("_range", F.when(F.col("_h").isin(*full), place).otherwise(-1) if keys else place).drop("_h", "_u", "_q"), True


def segmented(df: DataFrame, keys: list[str], order: list[str], us: str, wait: int, size: int, active: str, gap: int = 0, ranges: int | None = None) -> DataFrame:
    """``df`` with ``_segment`` (from 1, of each key) and ``_starts`` (whether the row starts it) of the rows where ``active``
    holds, in the order of each key; others have nulls. Without keys all rows are of one key. Rules as in ``next_starts``.

    A key that fills more than one of ``ranges`` ranges is cut by time; by default there are as many as shuffle partitions, or,
    if there are keys and Spark estimates less than MIN_BYTES, keys are not looked at. Each range is summed up, in parallel, as a chain: what it does to an open segment. Following the chains, a few numbers a range, tells
    with what open segment each range begins, and then all ranges are marked in parallel. Other keys stay in one task each.
    """
    spark = df.sparkSession
    ship_package(spark)
    small = ranges is None and keys and estimated_bytes(df.select(*keys, us)) < MIN_BYTES
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, cut = (df.withColumn("_range", F.lit(-1)), False) if small else _ranges(df, keys, us, order[-1], ranges)
    known: dict[tuple, tuple[int, int, int, int]] = {}
    by = ["_range", *keys]
    deal = F.when(F.col("_range") >= 0, F.xxhash64(F.lit("range"), "_range")).otherwise(F.xxhash64(*keys) if keys else F.lit(0).cast("long"))
    key_fields = [df.schema[k] for k in keys]
    if cut:
        narrow = rows.filter((F.col("_range") >= 0) & F.col(active)).select(*by, *order, us)
        dealt = narrow.repartition(ranges, deal).sortWithinPartitions(*by, *order)
        chain_schema = StructType([*StructType.fromDDL("_range int").fields, *key_fields, *StructType.fromDDL(CHAIN).fields])
        state_schema = StructType([*StructType.fromDDL("_range int").fields, *key_fields, *StructType.fromDDL("_number bigint, _count bigint, _first bigint, _last bigint").fields])

        def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def hand_on():
                k = len(chain.place)
                numbers = [np.full(k, chain.n), np.full(k, chain.begin), np.full(k, chain.last), chain.place, chain.time, chain.first, chain.count, chain.starts]
                own = [pa.array([x] * k, t) for x, t in zip(at[1], types)]
                return pa.RecordBatch.from_arrays([*own, *map(pa.array, numbers)], names=[f.name for f in chain_schema])

            at, chain, types = None, None, []
            for batch in batches:
                if not batch.num_rows:
                    continue
                news, key_of = _blocks(batch, by)
                times = np.asarray(batch.column(batch.schema.get_field_index(us)).fill_null(0))
                types = [batch.schema.field(batch.schema.get_field_index(k)).type for k in by]
                for a, b in zip([0, *news.tolist()], [*news.tolist(), batch.num_rows]):
                    key = key_of(a)
                    if at is None or key != at[0]:
                        if at is not None:
                            yield hand_on()
                        at, chain = (key, [batch.column(batch.schema.get_field_index(k))[a].as_py() for k in by]), Chain(wait, size, gap)
                    chain.add(times[a:b])
            if at is not None:
                yield hand_on()

        def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The state before each range of a key; one range's chain at a time."""
            held, at, state = [], None, (0, 0, 0, 0)

            def take():
                nonlocal state
                if at is not None:
                    state = follow(state, np.concatenate(held, axis=1), wait, size, gap)

            for batch in batches:
                if not batch.num_rows:
                    continue
                news, key_of = _blocks(batch, by)
                numbers = np.stack([np.asarray(batch.column(batch.num_columns - 8 + i)) for i in range(8)])
                found: list[tuple[int, tuple]] = []
                for a, b in zip([0, *news.tolist()], [*news.tolist(), batch.num_rows]):
                    key = key_of(a)
                    if key != at:
                        take()
                        if at is None or key[1:] != at[1:]:
                            state = (0, 0, 0, 0)
                        found.append((a, state))
                        held, at = [], key
                    held.append(numbers[:, a:b])
                own = batch.take(pa.array([a for a, _ in found], pa.int64()))
                states = [pa.array([s[i] for _, s in found], pa.int64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*own.columns[: len(by)], *states], names=[f.name for f in state_schema])

        chains = dealt.mapInArrow(sum_up, chain_schema)
        chains = (chains.repartition(*[F.col(k) for k in keys]) if keys else chains.repartition(1)).sortWithinPartitions(*keys, "_range", "_place")
        states = chains.mapInArrow(trace, state_schema).toArrow()  # a row a range
        values = list(zip(*(c.to_pylist() for c in states.columns)))
        known = {_plain(v[:-4]): v[-4:] for v in values}

    dealt = rows.repartition(ranges, deal).sortWithinPartitions(*by, *order)
    schema = StructType([*df.schema.fields, *StructType.fromDDL("_segment bigint, _starts boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, (0, 0, 0, 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            news, key_of = _blocks(batch, by)
            on = np.asarray(col(active).fill_null(False))
            times = np.asarray(col(us).fill_null(0))
            segment, starts = np.zeros(n, np.int64), np.zeros(n, bool)
            key = key_of(0)
            cuts = [0, *news.tolist()] if key != at else news.tolist()
            # Keys that go on from an earlier range begin a run of their own; others are marked side by side.
            split = sorted({0, *(c for c in cuts if key_of(c) in known)}) if known else [0]
            for a, b in zip(split, [*split[1:], n]):
                mine = np.array([c - a for c in cuts if a <= c < b], np.int64)
                if a in cuts:
                    state = known.get(key_of(a), (0, 0, 0, 0))
                    mine = mine[mine > 0] if state[0] else mine
                where = a + np.flatnonzero(on[a:b])
                if len(where):
                    begins = np.unique(np.searchsorted(where, a + mine, "left"))
                    begins = begins[begins < len(where)]
                    mark, after = segment_starts(times[where], begins, wait, size, gap, state)
                    total = np.cumsum(mark)
                    base = np.zeros(len(where), np.int64)
                    if len(begins):
                        base[begins[0] :] = np.repeat(total[begins] - mark[begins], np.diff(np.append(begins, len(where))))
                        base[: begins[0]] = -state[0]
                    else:
                        base[:] = -state[0]
                    starts[where], segment[where] = mark, total - base
                    state = after if not len(mine) or on[a + mine[-1] : b].any() else (0, 0, 0, 0)
                elif len(mine):
                    state = (0, 0, 0, 0)
            at = key_of(n - 1)
            kept = [c for c, name in zip(batch.columns, batch.schema.names) if name != "_range"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(segment, mask=~on), pa.array(starts, mask=~on)], names=[f.name for f in schema])

    return dealt.mapInArrow(run, schema)
