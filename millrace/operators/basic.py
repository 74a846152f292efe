"""One-to-one operators: map, parallel map, filter, tap, sample, buffer."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.functions.envelope import ERR, META, SEQ, TS, error_struct, is_error, is_success, no_metadata, payload
from millrace.functions.fnv import with_fnv1a_mod
from millrace.functions.shipping import ship_package


def mapper(df: DataFrame, outputs: dict[str, Column], fails: Column | None = None, message: Column | None = None, name: str = "mapper") -> DataFrame:
    """A projection of successes to ``outputs``. Rows where ``fails`` holds become errors. Errors pass with a null item,
    this operator's name and their cause and time; metadata is dropped from both, as every output is a new row."""
    bad = F.coalesce(fails, F.lit(False)) if fails is not None else F.lit(False)
    item = F.lit(None).cast(df.schema[ERR].dataType["item"].dataType)
    message = F.lit("failed") if message is None else message
    err = F.when(is_error(), error_struct(item, F.col(ERR)["message"], name, F.col(ERR)["ts"])).when(bad, error_struct(item, message, name, F.col(TS)))
    out = {c: F.when(is_success() & ~bad, e) for c, e in outputs.items()}
    return df.select(*[e.alias(c) for c, e in out.items()], SEQ, TS, err.alias(ERR), no_metadata().alias(META))


def async_mapper(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], outputs: str, ordered: bool = True, workers: int = 0, name: str = "async-mapper") -> DataFrame:
    """An opaque function over batches of successes, in parallel: it gets the payload columns and returns the ``outputs``
    (DDL) and, in a column ``_message``, the text of a failure or null. ``workers``: partitions, as they are if not
    positive. With ``ordered`` the result is sorted by arrival."""
    ship_package(df.sparkSession)
    own = [x.strip().split()[0] for x in outputs.split(",")]
    item = df.schema[ERR].dataType["item"].dataType
    rows = df.repartition(workers) if workers > 0 else df
    columns = payload(df)
    before = rows.withColumns({"_ok": is_success()}).select(*columns, SEQ, TS, "_ok", F.col(ERR)["message"].alias("_m"), F.col(ERR)["ts"].alias("_t"))
    kind = {f.name: f.dataType.simpleString() for f in before.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = fn(pdf.loc[pdf["_ok"], columns])
            out = pdf[[SEQ, TS, "_ok", "_m", "_t"]].join(done[[*own, "_message"]])
            yield out[[*own, SEQ, TS, "_ok", "_m", "_t", "_message"]]

    out = before.mapInPandas(run, f"{outputs}, {SEQ} {kind[SEQ]}, {TS} {kind[TS]}, _ok boolean, _m string, _t timestamp_ntz, _message string")
    none = F.lit(None).cast(item)
    err = F.when(~F.col("_ok"), error_struct(none, F.col("_m"), name, F.col("_t"))).when(F.col("_message").isNotNull(), error_struct(none, F.col("_message"), name, F.col(TS)))
    good = F.col("_ok") & F.col("_message").isNull()
    out = out.select(*[F.when(good, F.col(c)).alias(c) for c in own], SEQ, TS, err.alias(ERR), no_metadata().alias(META))
    return out.orderBy(TS, SEQ) if ordered else out


def enrich(df: DataFrame, lookup: DataFrame, on: str, key: str, message: str, name: str = "enrich", small: bool = False) -> DataFrame:
    """Look up each success by ``on`` = ``key`` of a table with unique keys; a missing key makes an error. ``small`` states
    that the table's size is bounded, so it may be sent to all tasks; else Spark decides by its statistics."""
    there = lookup.withColumn("_hit", F.lit(True))
    joined = df.join(F.broadcast(there) if small else there, df[on] == lookup[key], "left")
    item = F.struct(*[F.col(c) for c in payload(df)])
    same = df.schema[ERR].dataType["item"].dataType
    err = F.when(is_error(), F.col(ERR)).when(F.col("_hit").isNull(), error_struct(item.cast(same), F.lit(message), name, F.col(TS)))
    return joined.withColumn(ERR, err).drop("_hit")


def filter_ok(df: DataFrame, predicate: Column, name: str = "filter") -> DataFrame:
    """Successes for which the predicate is true (null is not); errors pass under this operator's name, without metadata."""
    out = df.filter(is_error() | predicate)
    return out.withColumns({ERR: F.when(is_error(), F.col(ERR).withField("processor", F.lit(name))), META: F.when(is_error(), no_metadata()).otherwise(F.col(META))})


def tap(df: DataFrame, metrics: dict[str, Column], name: str = "tap") -> tuple[DataFrame, Observation]:
    """The same rows, and an observation that holds the metrics once an action has run over them."""
    seen = Observation(name)
    return df.observe(seen, *[e.alias(k) for k, e in metrics.items()]), seen


def tap_rows(df: DataFrame, fn: Callable[[pd.DataFrame], None]) -> DataFrame:
    """The same rows, each batch shown to ``fn`` where it is processed; what ``fn`` raises is swallowed there."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                fn(pdf.copy())
            except Exception as e:  # a tap never stops the stream
                print(f"tap: {e}")
            yield pdf

    return df.mapInPandas(run, df.schema)


def _rate(rate: float) -> float:
    if math.isnan(rate) or math.isinf(rate) or not 0 <= rate <= 1:
        raise ValueError("rate must lie between 0 and 1")
    return rate


def sample(df: DataFrame, rate: float, seed: int | None = None) -> DataFrame:
    """Each success independently with probability ``rate``; errors pass."""
    u = F.rand(seed) if seed is not None else F.rand()
    return df.filter(is_error() | (u < _rate(rate)))


def sample_by_key(df: DataFrame, rate: float, key: str) -> DataFrame:
    """A reproducible sample of successes: those whose key falls into ``rate`` of 1000 hash buckets; errors pass."""
    rows = with_fnv1a_mod(df, key, 1000, "_bucket")
    return rows.filter(is_error() | (F.col("_bucket") < round(_rate(rate) * 1000))).drop("_bucket")


def buffer(df: DataFrame, size: int = 0, persist: bool = False) -> DataFrame:
    """The same rows. Spark pulls, so there is nothing to decouple; ``persist`` keeps them for several readers."""
    if size < 0:
        raise ValueError("size must not be negative")
    return df.persist() if persist else df
