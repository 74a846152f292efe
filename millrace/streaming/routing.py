"""A switch whose routes change while its stream runs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from millrace.operators.route import Switch

ROUTES = "place int, route string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _write(spark: SparkSession, path: str, routes: list[str]) -> None:
    spark.createDataFrame(list(enumerate(routes)), ROUTES).coalesce(1).write.mode("overwrite").parquet(path)


def _read(spark: SparkSession, path: str) -> list[str]:
    return [r.route for r in spark.read.schema(ROUTES).parquet(path).orderBy("place").collect()]


class RouteTable:
    """The routes of a switch in a folder, a version for each change; any process that sees the folder can read and change them.
    One process changes them at a time."""

    def __init__(self, spark: SparkSession, folder: str, routes: list[str] | None = None):
        self.spark, self.folder = spark, folder
        if routes is not None:
            self._change(list(dict.fromkeys(routes)))

    def _versions(self) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/*/_SUCCESS")
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p) or []
        return sorted(int(x.getPath().getParent().getName()) for x in found)

    def _change(self, routes: list[str]) -> None:
        last = self._versions()
        _write(self.spark, f"{self.folder}/{max([time.time_ns() // 1000, *(v + 1 for v in last)])}", routes)

    def routes(self) -> list[str]:
        versions = self._versions()
        return _read(self.spark, f"{self.folder}/{versions[-1]}") if versions else []

    def add_route(self, key: str) -> RouteTable:
        """Add a route; one that is there stays as it is."""
        now = self.routes()
        if key not in now:
            self._change([*now, key])
        return self

    def remove_route(self, key: str) -> bool:
        """Whether the route was there."""
        now = self.routes()
        if key in now:
            self._change([r for r in now if r != key])
        return key in now

    def has_route(self, key: str) -> bool:
        return key in self.routes()


def switched_sink(df: DataFrame, key: Column, table: RouteTable, sink: Callable[[DataFrame, int], None], folder: str, default: str | None = None, name: str = "switch",
                  once: bool = True) -> StreamingQuery:
    """Each micro-batch through ``Switch`` with the routes that the table has when the batch is first begun, to ``sink``. The routes of a
    batch are kept with it in ``folder``, beside the query's checkpoint, so a batch that runs again takes the same ones. A default
    that is not among the routes at the time does not count: rows without a route are dropped."""

    def each(batch: DataFrame, number: int) -> None:
        spark, kept = batch.sparkSession, f"{folder}/routes/{number}"
        if not _exists(spark, f"{kept}/_SUCCESS"):
            _write(spark, kept, table.routes())
        routes = _read(spark, kept)
        switch = Switch(key, default=default if default in routes else None, name=name)
        for r in routes:
            switch.add_route(r)
        sink(switch.process(batch), number)

    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()
