"""Windows, routing and sinks on unbounded streams, with watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from millrace.functions.envelope import TS, is_error, is_success


def _marked(df: DataFrame, lateness: str) -> DataFrame:
    return df.withColumn(TS, F.col(TS).cast("timestamp")).withWatermark(TS, lateness)


def _counts(aggregates: dict[str, Column] | None) -> list[Column]:
    return [F.count("*").alias("item_count"), F.count_if(is_success()).alias("success_count"), F.count_if(is_error()).alias("error_count"),
            *[a.alias(k) for k, a in (aggregates or {}).items()]]


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), F.col("window.end").cast("timestamp_ntz").alias("window_end"),
                     *[c for c in df.columns if c not in ("window", "session_window")])


def tumbling(df: DataFrame, size: str, lateness: str = "0 seconds", aggregates: dict[str, Column] | None = None, by: list[str] | None = None) -> DataFrame:
    """Collected tumbling windows; each is final once the watermark passes its end."""
    return _flat(_marked(df, lateness).groupBy(F.window(TS, size), *(by or [])).agg(*_counts(aggregates)))


def monitor(df: DataFrame, interval: str, seconds: float, lateness: str = "0 seconds") -> DataFrame:
    """By interval, final once the watermark passes its end: item count and rate (per second); the rows are left as they are."""
    out = _marked(df, lateness).groupBy(F.window(TS, interval)).agg(F.count("*").alias("item_count"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start_ts"), F.col("window.end").cast("timestamp_ntz").alias("end_ts"), "item_count",
                      F.round(F.col("item_count") / seconds, 6).alias("rate"))


def sliding(df: DataFrame, size: str, slide: str, lateness: str = "0 seconds", aggregates: dict[str, Column] | None = None) -> DataFrame:
    """Collected sliding windows, counted from the epoch, whose first slide holds a row."""
    out = _marked(df, lateness).groupBy(F.window(TS, size, slide)).agg(F.min(TS).alias("_first"), *_counts(aggregates))
    return _flat(out.filter(F.col("_first") < F.col("window.start") + F.expr(f"interval {slide}")).drop("_first"))


def session(df: DataFrame, key: str, gap: str, lateness: str = "0 seconds", aggregates: dict[str, Column] | None = None) -> DataFrame:
    """Collected sessions of each key."""
    out = _marked(df, lateness).groupBy(key, F.session_window(TS, gap).alias("window")).agg(*_counts(aggregates))
    return _flat(out)


def dedupe_within(df: DataFrame, keys: list[str], lateness: str) -> DataFrame:
    """The first row of each key within the watermark's delay (approximate lifetime, bounded state)."""
    return _marked(df, lateness).dropDuplicatesWithinWatermark(keys)


def dead_letter_sinks(df: DataFrame, good: Callable[[DataFrame, int], None], bad: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Successes to one sink, errors to another, a micro-batch at a time."""
    return routed_sinks(df, {"good": (is_success(), good), "bad": (is_error(), bad)}, checkpoint, once)


def routed_sinks(df: DataFrame, routes: dict[str, tuple[Column, Callable[[DataFrame, int], None]]], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch to the sinks of all routes whose predicate its rows meet. A batch is read once for all of them."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for predicate, sink in routes.values():
                sink(batch.filter(predicate), number)
        finally:
            batch.unpersist()

    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def run_to_memory(df: DataFrame, name: str, checkpoint: str | None = None, mode: str = "append") -> DataFrame:
    """Drain what is available into an in-memory table: for tests and small replays."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
