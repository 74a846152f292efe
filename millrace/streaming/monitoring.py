"""What a running stream tells of itself: metrics a micro-batch to a callback, and statistics an interval, across micro-batches.

Metrics of a micro-batch are aggregated by Spark on the way and come to a query listener. Statistics of an interval are summed up a
micro-batch in parallel; only the sums of intervals that are still open go on to the next one, in a table a batch id, so that a batch
that runs again begins with the same ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from millrace.functions.envelope import SEQ, TS, from_micros, micros
from millrace.functions.ordering import with_neighbour

#: Sums of an interval (its start ``w``); the row without ``w`` holds the latest time seen.
SUMS = "w long, n long, n_latency long, latency long, least long, greatest long, last long"


class _Listener(StreamingQueryListener):
    def __init__(self, name: str, fn: Callable[[int, Row], None]):
        self.name, self.fn = name, fn

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            try:
                self.fn(event.progress.batchId, found)
            except Exception as e:  # a tap never stops the stream
                print(f"tap: {e}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def tap_stream(df: DataFrame, metrics: dict[str, Column], fn: Callable[[int, Row], None], name: str = "tap") -> tuple[DataFrame, Callable[[], None]]:
    """The same rows, and a function that ends the tap. ``fn`` gets the number of each micro-batch that has ended and its metrics, in
    the driver and after the batch's rows are written; what it raises is swallowed. A batch that runs again may be told twice, and
    what was not told when the driver was lost is not told later: for exact accounts take ``monitored_sink``."""
    listener = _Listener(f"{name}-{uuid.uuid4().hex}", fn)
    df.sparkSession.streams.addListener(listener)
    return df.observe(listener.name, *[e.alias(k) for k, e in metrics.items()]), lambda: df.sparkSession.streams.removeListener(listener)


def _kept(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """The sums after a micro-batch; none before the first."""
    return spark.read.schema(SUMS).parquet(f"{folder}/sums/{number}") if number >= 0 else spark.createDataFrame([], SUMS)


def _merged(sums: DataFrame) -> DataFrame:
    return sums.groupBy("w").agg(*[f(c).alias(c) for f, c in ((F.sum, "n"), (F.sum, "n_latency"), (F.sum, "latency"), (F.min, "least"), (F.max, "greatest"), (F.max, "last"))])


def _statistics(sums: DataFrame, interval: int) -> DataFrame:
    """The columns of the batch form ``monitor``."""
    return sums.select(
        from_micros(F.col("w")).alias("start_ts"), from_micros(F.col("w") + interval).alias("end_ts"), F.col("n").alias("item_count"),
        F.round(F.col("n") / F.lit(interval / 1e6), 6).alias("rate"), F.round(F.try_divide(F.col("latency").cast("double"), F.col("n_latency")), 2).alias("avg_latency"),
        F.col("least").alias("min_latency"), F.col("greatest").alias("max_latency"))


def monitored_sink(df: DataFrame, interval: int, on_stats: Callable[[Row], None], sink: Callable[[DataFrame, int], None], folder: str,
                   latency: Column | None = None, lateness: int = 0, once: bool = True) -> StreamingQuery:
    """Each micro-batch unchanged to ``sink``, then the statistics of each interval (microseconds of event time) that has ended to ``on_stats``,
    in order of time: ``start_ts, end_ts, item_count, rate, avg_latency, min_latency, max_latency``, those of ``operators.aggregate.monitor``.

    An interval ends once a row ``lateness`` past it was seen. Rows that come later still are told by a further call for their
    interval, so counts of an interval's calls add up to its rows. ``latency`` (microseconds) is by default the time since the
    row before: within a micro-batch in order of time, and for its first row the latest row of the batches before, if that is no
    later. Rows without a time belong to no interval. Only intervals with rows are told. A batch that runs again has the same statistics and tells them
    again; what ``on_stats`` raises fails the batch. ``folder`` holds the query's checkpoint and the sums of open intervals."""
    if interval <= 0:
        raise ValueError("interval must be positive")

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _kept(spark, folder, number - 1)
        batch = batch.persist()
        try:
            rows = batch.withColumn("_us", micros(F.col(TS))).filter("_us is not null")
            reach = before.agg(F.max("last")).first()[0]  # one number
            if latency is not None:
                rows = rows.withColumn("_latency", latency)
            else:
                first = F.when(F.lit(reach) <= F.col("_us"), F.lit(reach)) if reach is not None else F.lit(None).cast("long")
                rows = with_neighbour(rows.select("_us", SEQ), "_us", SEQ, "_prev", after=False)
                rows = rows.withColumn("_latency", F.col("_us") - F.coalesce("_prev", first))
            x = F.col("_latency").cast("long")
            own = rows.withColumn("w", F.col("_us") - F.pmod("_us", F.lit(interval))).groupBy("w").agg(
                F.count("*").alias("n"), F.count(x).alias("n_latency"), F.sum(x).alias("latency"), F.min(x).alias("least"), F.max(x).alias("greatest"), F.max("_us").alias("last"))
            path = f"{folder}/all/{number}"
            _merged(before.unionByName(own)).write.mode("overwrite").parquet(path)
            every = spark.read.schema(SUMS).parquet(path)
            reach = every.agg(F.max("last")).first()[0]
            ended = F.col("w") + interval + lateness <= F.lit(reach).cast("long")
            still = every.filter(F.col("w").isNotNull() & ~F.coalesce(ended, F.lit(False)))
            mark = spark.createDataFrame([(None, 0, 0, None, None, None, reach)], SUMS)
            still.unionByName(mark).write.mode("overwrite").parquet(f"{folder}/sums/{number}")
            sink(batch, number)
            for row in _statistics(every.filter(ended), interval).orderBy("start_ts").toLocalIterator():
                on_stats(row)
        finally:
            batch.unpersist()

    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def open_statistics(spark: SparkSession, folder: str, interval: int, number: int) -> DataFrame:
    """The statistics so far of the intervals that were open after micro-batch ``number``: what is left to tell when a stream ends."""
    return _statistics(_kept(spark, folder, number).filter("w is not null"), interval)
