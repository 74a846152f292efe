"""Flow over an order: batch, chunk, throttle, debounce, dedupe, take, skip, buffers that keep a few."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.envelope import ERR, SEQ, TS, is_error, is_success, micros
from millrace.functions.fold import block_fold, segmented
from millrace.functions.ordering import numbered, with_neighbour


#: Rows that a sorted limit keeps in each task, at most.
MAX_TOP = 1_000_000
#: Lifetime of a key that dedupe forgets it after, where none is given as such (a fixed value of the documented interface).
DEFAULT_TTL = 3_600_000_000


def number_successes(df: DataFrame, keys: list[str], name: str = "_n") -> DataFrame:
    """Successes numbered from 1 in arrival order: of each key, or of all rows without a global task."""
    if not keys:
        return numbered(df, TS, SEQ, name, where=is_success())
    w = Window.partitionBy(*keys).orderBy(TS, SEQ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.when(is_success(), F.count_if(is_success()).over(w)))


def batch_step(max_size: int, latency: int):
    """A row starts a new batch if none is open, the open one is full, or its first row is ``latency`` microseconds old."""

    def step(state, us):
        number, n, first = state or (0, 0, 0)
        if n == 0 or n >= max_size or (latency > 0 and us - first >= latency):
            number, n, first = number + 1, 0, us
        return (number, n + 1, first), (number,)

    return step


def batch(df: DataFrame, max_size: int, latency: int = 0, keys: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Successes with a ``batch_id`` from 1 (of each key). A batch ends at ``max_size`` rows (0: one row each) or, if
    ``latency`` (microseconds) is positive, before a row that arrives that long after its first. Errors pass without. Many rows
    of one key, or of none, are worked on in ranges side by side (``ranges``: how many, even if they are few rows)."""
    keys, size = keys or [], max(1, max_size)
    if latency <= 0:
        n = number_successes(df, keys)
        return n.withColumn("batch_id", F.floor((F.col("_n") - 1) / size) + 1).drop("_n")
    rows = df.withColumns({"_us": micros(F.col(TS)), "_on": is_success()})
    return segmented(rows, keys, [TS, SEQ], "_us", latency, size, "_on", ranges=ranges).withColumnRenamed("_segment", "batch_id").drop("_us", "_on", "_starts")


def collect_batches(df: DataFrame, columns: list[str], keys: list[str] | None = None, batch: str = "batch_id") -> DataFrame:
    """A row for each batch: ``items``, an array of structs in arrival order. Batches are bounded by their size."""
    item = F.struct(TS, SEQ, *columns)
    out = df.filter(is_success()).groupBy(*(keys or []), batch).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return out.withColumn("items", F.transform("items", lambda x: F.struct(*[x[c].alias(c) for c in columns])))


def chunk(df: DataFrame, size: int, keys: list[str] | None = None) -> DataFrame:
    """Successes in chunks of ``size``, the last one maybe shorter: ``chunk_id`` from 0 and ``chunk_place`` from 0."""
    if size < 1:
        raise ValueError("size must be positive")
    n = number_successes(df, keys or [])
    return n.withColumns({"chunk_id": F.floor((F.col("_n") - 1) / size), "chunk_place": (F.col("_n") - 1) % size}).drop("_n")


def unbatch(df: DataFrame, items: str, item: str = "item") -> DataFrame:
    """A row for each element of an array, in order (``item`` and ``place``); empty and null arrays give none."""
    rest = [c for c in df.columns if c != items]
    return df.select(*rest, F.posexplode(items).alias("place", item))


def flatten(df: DataFrame, items: str) -> DataFrame:
    """One level of nesting less: an array of arrays becomes an array."""
    return df.withColumn(items, F.flatten(items))


def throttle_step(duration: int):
    def step(last, us):
        keep = last is None or us - last >= duration
        return (us if keep else last), (keep,)

    return step


def throttle(df: DataFrame, duration: int, keys: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Successes at least ``duration`` microseconds after the last one let through (of the key); the first passes, and what
    is dropped starts no new pause. Errors pass. Many rows of one key, or of none, are worked on in ranges side by side (``ranges``: how many, even if they are few rows)."""
    if duration <= 0:
        return df
    rows = df.withColumns({"_us": micros(F.col(TS)), "_on": is_success()})
    out = segmented(rows, keys or [], [TS, SEQ], "_us", duration, 0, "_on", ranges=ranges)
    return out.filter(is_error() | F.col("_starts")).drop("_us", "_on", "_segment", "_starts")


def bucket_step(interval: int, burst: int):
    """Tokens in units of one token's interval, so the arithmetic is whole."""

    def step(state, us):
        tokens, last = state or (burst * interval, us)
        tokens = min(burst * interval, tokens + us - last)
        keep = tokens >= interval
        return (tokens - interval * keep, us), (keep,)

    return step


def bucket_block(interval: int, burst: int):
    """The same over a key's ordered times: the bucket as the time at which it is full again, which a run of accepted rows moves on
    by an interval each, or to an interval after a row that finds it full; the first row that comes too soon ends the run, and
    the next that does not begins another."""
    spare = (burst - 1) * interval

    def block(full: int | None, us: np.ndarray) -> tuple[int, tuple[np.ndarray]]:
        n, keep, i = len(us), np.zeros(len(us), bool), 0
        full = int(us[0]) if full is None else full
        while i < n:
            length = 8
            while i < n:  # a run of accepted rows, looked at in longer and longer pieces
                piece = us[i : i + length]
                steps = np.arange(len(piece) + 1) * interval
                reach = steps + np.maximum.accumulate(np.append(full, piece - steps[:-1]))  # when it is full again, before each row
                late = reach[:-1] - piece > spare
                k = int(late.argmax()) if late.any() else len(piece)
                keep[i : i + k] = True
                full, i, length = (max(int(reach[k - 1]), int(piece[k - 1])) + interval if k else full), i + k, 2 * length
                if k < len(piece):
                    break
            i = max(i, int(np.searchsorted(us, full - spare, "left"))) if i < n else n
        return full, (keep,)

    return block


def token_bucket(df: DataFrame, interval: int, burst: int = 1, keys: list[str] | None = None) -> DataFrame:
    """Successes that find a token: one comes every ``interval`` microseconds, up to ``burst`` wait. Errors pass."""
    rows = df.withColumns({"_us": micros(F.col(TS)), "_on": is_success()})
    out = block_fold(rows, keys or [], [TS, SEQ], ["_us"], bucket_block(interval, burst), "_keep boolean", active="_on")
    return out.filter(is_error() | F.col("_keep")).drop("_us", "_on", "_keep")


def debounce(df: DataFrame, duration: int, keys: list[str] | None = None) -> DataFrame:
    """Successes followed by ``duration`` microseconds without another one, or by none; ``emitted_at`` is when. Errors
    pass and don't reset the wait."""
    rows = df.withColumns({"_good": is_success(), "_us": micros(F.col(TS))})
    if keys:
        rows = rows.withColumn("_next", F.lead("_us").over(Window.partitionBy(*keys, "_good").orderBy(TS, SEQ)))
    else:
        good = with_neighbour(rows.filter("_good"), "_us", SEQ, "_next")
        rows = good.unionByName(rows.filter("not _good").withColumn("_next", F.lit(None).cast("long")))
    quiet = F.col("_next").isNull() | (F.col("_next") - F.col("_us") >= duration)
    out = rows.filter(is_error() | quiet).withColumn("emitted_at", F.when(is_success(), F.timestamp_micros(F.col("_us") + duration).cast("timestamp_ntz")))
    return out.drop("_good", "_us", "_next")


def dedupe(df: DataFrame, keys: list[str], ttl: int | None = DEFAULT_TTL, ranges: int | None = None) -> DataFrame:
    """The successes of each key that come ``ttl`` microseconds or more after the last one let through; without one
    (None), the first of each key. Errors pass."""
    if ttl is not None:
        return throttle(df, ttl, keys, ranges)
    # Summed in each task before the exchange: a frequent key sends one row of each.
    kept = df.filter(is_success()).groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(TS, SEQ)).alias("_row")).select("_row.*")
    return kept.unionByName(df.filter(is_error()))


def take(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` successes; errors pass uncounted."""
    return df.filter(is_success()).orderBy(TS, SEQ).limit(max(0, n)).unionByName(df.filter(is_error()))


def skip(df: DataFrame, n: int) -> DataFrame:
    """Successes but the first ``n``; errors pass uncounted. The last one skipped is found by a top-n; beyond MAX_TOP the
    rows are numbered instead."""
    if n <= 0:
        return df
    if n > MAX_TOP:
        return number_successes(df, []).filter(is_error() | (F.col("_n") > n)).drop("_n")
    last = df.filter(is_success()).select(TS, SEQ).orderBy(TS, SEQ).limit(n).agg(F.max(F.struct(TS, SEQ)).alias("_last"))
    return df.join(F.broadcast(last), F.lit(True)).filter(is_error() | (F.struct(TS, SEQ) > F.col("_last"))).drop("_last")  # one row


def paginate(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """Successes ``offset`` to ``offset + limit``; errors pass. A page is a top-n; beyond MAX_TOP the rows are numbered."""
    if offset + limit > MAX_TOP:
        n = number_successes(df, [])
        return n.filter(is_error() | ((F.col("_n") > offset) & (F.col("_n") <= offset + limit))).drop("_n")
    return df.filter(is_success()).orderBy(TS, SEQ).offset(max(0, offset)).limit(max(0, limit)).unionByName(df.filter(is_error()))


def dropping_buffer(df: DataFrame, size: int, keys: list[str]) -> DataFrame:
    """The newest ``size`` successes of each key; ``dropped_count`` is what overflowed of the key. Errors pass."""
    w = Window.partitionBy(*keys, "_good").orderBy(F.desc(TS), F.desc(SEQ))
    rows = df.withColumn("_good", is_success())
    rows = rows.withColumns({"_rn": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(*keys, "_good"))})
    kept = rows.filter(is_error() | (F.col("_rn") <= size))
    return kept.withColumn("dropped_count", F.when(is_success(), F.greatest(F.col("_n") - size, F.lit(0)))).drop("_good", "_rn", "_n")


def sliding_buffer(df: DataFrame, size: int, aggregates: dict[str, Column], keys: list[str]) -> DataFrame:
    """Every success with aggregates over the last ``size`` ones of its key, itself included. Errors pass with nulls."""
    w = Window.partitionBy(*keys, "_good").orderBy(TS, SEQ).rowsBetween(1 - size, 0)
    rows = df.withColumn("_good", is_success())
    return rows.withColumns({k: F.when(is_success(), a.over(w)) for k, a in aggregates.items()}).drop("_good")


def statistics(df: DataFrame, kept: DataFrame) -> DataFrame:
    """``unique_count`` and ``duplicate_count`` of a dedupe's input and output."""
    before = df.agg(F.count_if(F.col(ERR).isNull()).alias("n"))
    return kept.agg(F.count_if(F.col(ERR).isNull()).alias("unique_count")).join(before, F.lit(True)).select("unique_count", (F.col("n") - F.col("unique_count")).alias("duplicate_count"))
