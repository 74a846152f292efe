"""What a running, or stopped, query holds in its state store, read as a table by Spark's state data source."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from millrace.functions.shipping import ship_package


def stored(spark: SparkSession, checkpoint: str, variable: str = "state", batch: int | None = None, operator: int = 0) -> DataFrame:
    """Keys and values of a state variable after a micro-batch, by default the last one that is complete."""
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).option("operatorId", operator)
    return (reader if batch is None else reader.option("batchId", batch)).load()


def current_state(spark: SparkSession, checkpoint: str, keys: list[str], out: str, read: Callable[[object], tuple] = lambda s: s, batch: int | None = None, operator: int = 0) -> DataFrame:
    """``keys`` and the columns ``out`` (a DDL string): of each key, what ``read`` makes of the state of an operator with a step
    function (throttle, batch, token bucket, circuit breaker, folds) after a micro-batch. The query may go on running."""
    ship_package(spark)
    rows = stored(spark, checkpoint, batch=batch, operator=operator)
    held = rows.schema["key"].dataType.names
    flat = rows.select(*[F.col("key")[h].alias(k) for h, k in zip(held, keys)], F.col("value.value").alias("_state"))
    own = StructType.fromDDL(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pd.DataFrame([read(pickle.loads(s)) for s in pdf["_state"]], columns=own.names, dtype=object)
            yield pd.concat([pdf[keys].reset_index(drop=True), found], axis=1)

    return flat.mapInPandas(run, StructType([StructField(k, flat.schema[k].dataType) for k in keys] + own.fields))


def fold_state(spark: SparkSession, checkpoint: str, keys: list[str], kind: str, batch: int | None = None) -> DataFrame:
    """The state of ``fold_by_count`` of each key: emissions so far, rows since the last one, and the ``state`` of the fold over them (of
    DDL type ``kind``)."""
    return current_state(spark, checkpoint, keys, f"emissions bigint, n bigint, state {kind}", batch=batch)
