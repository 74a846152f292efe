"""Tumbling, sliding and session windows over the timestamp column, and their collection.

As in the stream they come from, windows annotate rows rather than hold them, and errors are in windows too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.envelope import (
    ERR, SEQ, SESSION_KEY, TS, WINDOW_END, WINDOW_GAP, WINDOW_SIZE, WINDOW_SLIDE, WINDOW_START, WINDOW_TYPE, from_micros, is_error, is_success, micros)
from millrace.functions.fold import segmented


def _marked(df: DataFrame, start: Column, end: Column, kind: str, size: int, slide: Column | None = None, gap: Column | None = None, key: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return df.withColumns({
        WINDOW_START: from_micros(start), WINDOW_END: from_micros(end), WINDOW_TYPE: F.lit(kind), WINDOW_SIZE: F.lit(size).cast("long"),
        WINDOW_SLIDE: (none if slide is None else slide).cast("long"), WINDOW_GAP: (none if gap is None else gap).cast("long"),
        SESSION_KEY: (none if key is None else key).cast("string")})


def _positive(size: int) -> int:
    if size <= 0:
        raise ValueError("a window's size must be positive")
    return size


def tumbling(df: DataFrame, size: int, anchor: int = 0) -> DataFrame:
    """Every row in its window of ``size`` microseconds, ``[start, end)``, counted from ``anchor`` (microseconds)."""
    us = micros(F.col(TS))
    start = us - F.pmod(us - anchor, F.lit(_positive(size)))
    return _marked(df, start, start + size, "tumbling", size)


def sliding(df: DataFrame, size: int, slide: int | None = None, keys: list[str] | None = None, anchor: int | None = None) -> DataFrame:
    """Every row in each window of ``size`` that is open when it comes. A window opens with the first row of its first
    ``slide``, so windows whose first slide is empty don't exist. Windows count from ``anchor``, by default from the
    first row (of each key). A slide equal to the size, the default, gives tumbling windows of type sliding."""
    slide = slide or size
    if slide > _positive(size):
        raise ValueError("a slide longer than the size leaves gaps")
    keys = keys or []
    rows = df.withColumn("_us", micros(F.col(TS)))
    if slide == size and anchor is None and not keys:
        anchor = 0
    if anchor is not None:
        rows = rows.withColumn("_first", F.lit(anchor).cast("long"))
    elif keys:
        rows = rows.withColumn("_first", F.min("_us").over(Window.partitionBy(*keys)))
    else:
        rows = rows.join(F.broadcast(rows.agg(F.min("_us").alias("_first"))), F.lit(True))  # one row
    rows = rows.withColumn("_b", F.expr(f"(_us - _first - pmod(_us - _first, {slide})) div {slide}"))
    if slide == size:
        start = F.col("_first") + F.col("_b") * slide
        return _marked(rows, start, start + size, "sliding", size, F.lit(slide)).drop("_us", "_first", "_b")
    # Occupied first slides, a row for each; a row of the stream meets the few buckets whose windows reach it.
    opened = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_ob")).distinct()
    reach = -(-size // slide) - 1
    cand = rows.withColumn("_o", F.explode(F.sequence(F.col("_b") - reach, F.col("_b"))))
    cand = cand.filter(F.col("_us") < F.col("_first") + F.col("_o") * slide + size)
    same = F.col("_o") == F.col("_ob")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = cand.join(opened, same, "left_semi")
    start = F.col("_first") + F.col("_o") * slide
    return _marked(out, start, start + size, "sliding", size, F.lit(slide)).drop("_us", "_first", "_b", "_o")


def _session_numbers(df: DataFrame, key: str, gap: int, most: int | None) -> DataFrame:
    """Rows with ``_us`` and the number ``_s`` of their key's session."""
    if gap <= 0 or (most is not None and most <= 0):
        raise ValueError("the gap and the longest duration must be positive")
    rows = df.withColumn("_us", micros(F.col(TS)))
    if most is not None:
        numbered = segmented(rows.withColumn("_on", F.lit(True)), [key], [TS, SEQ], "_us", most, 0, "_on", gap)
        return numbered.withColumnRenamed("_segment", "_s").drop("_on", "_starts")
    order = Window.partitionBy(key).orderBy(TS, SEQ)
    new = F.coalesce(F.col("_us") - F.lag("_us").over(order) > gap, F.lit(True))
    return rows.withColumn("_new", new.cast("int")).withColumn("_s", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _session_end(last: Column, first: Column, gap: int, most: int | None) -> Column:
    return last + gap if most is None else F.least(last + gap, first + most)


def session(df: DataFrame, key: str, gap: int, most: int | None = None) -> DataFrame:
    """Every row in its key's session: sessions end when ``gap`` microseconds and more pass without a row; the end is the
    last row's time plus the gap. A row exactly ``gap`` after the last one still belongs to the session. With ``most``, a
    session is closed ``most`` microseconds after its first row at the latest, and a row that comes then opens another."""
    rows = _session_numbers(df, key, gap, most)
    whole = Window.partitionBy(key, "_s")
    rows = rows.withColumns({"_start": F.min("_us").over(whole), "_last": F.max("_us").over(whole)})
    end = _session_end(F.col("_last"), F.col("_start"), gap, most)
    return _marked(rows, F.col("_start"), end, "session", 0, gap=F.lit(gap), key=F.col(key)).drop("_us", "_s", "_start", "_last")


def sessions(df: DataFrame, key: str, gap: int, aggregates: dict[str, Column], most: int | None = None) -> DataFrame:
    """Sessions as rows: ``key``, bounds and aggregates. Merged by Spark's own session operator, or, with ``most``, summed up in
    each task before they are put together."""
    named = [a.alias(k) for k, a in aggregates.items()]
    if most is not None:
        out = _session_numbers(df, key, gap, most).groupBy(key, "_s").agg(F.min("_us").alias("_start"), F.max("_us").alias("_last"), *named)
        end = _session_end(F.col("_last"), F.col("_start"), gap, most)
        return out.select(key, from_micros(F.col("_start")).alias(WINDOW_START), from_micros(end).alias(WINDOW_END), *aggregates)
    w = F.session_window(TS, f"{gap} microseconds")
    return df.groupBy(key, w.alias("w")).agg(*named).select(key, F.col("w.start").alias(WINDOW_START), F.col("w.end").alias(WINDOW_END), *aggregates)


def collect_windows(df: DataFrame, by: list[str] | None = None, aggregates: dict[str, Column] | None = None) -> DataFrame:
    """A row for each window (equal start and end, whatever the session): ``item_count, success_count, error_count``. Rows
    without a window are left out. ``by`` tells windows apart by more, such as the session key."""
    more = {k: a for k, a in (aggregates or {}).items()}
    return df.filter(F.col(WINDOW_START).isNotNull() & F.col(WINDOW_END).isNotNull()).groupBy(*(by or []), WINDOW_START, WINDOW_END).agg(
        F.count("*").alias("item_count"), F.count_if(is_success()).alias("success_count"), F.count_if(is_error()).alias("error_count"), *[a.alias(k) for k, a in more.items()])


def collect_values(df: DataFrame, c: str) -> DataFrame:
    """The successes' values of each window as an array in arrival order. For windows of bounded size."""
    pairs = F.sort_array(F.collect_list(F.when(is_success(), F.struct(TS, SEQ, F.col(c).alias("v")))))
    return df.groupBy(WINDOW_START, WINDOW_END).agg(F.transform(pairs, lambda x: x["v"]).alias("items"))


def collect_errors(df: DataFrame) -> DataFrame:
    """The errors of each window as an array of error structs in arrival order. For windows of bounded size."""
    pairs = F.sort_array(F.collect_list(F.when(is_error(), F.struct(TS, SEQ, F.col(ERR).alias("e")))))
    return df.filter(F.col(WINDOW_START).isNotNull()).groupBy(WINDOW_START, WINDOW_END).agg(F.transform(pairs, lambda x: x["e"]).alias("errors"))
