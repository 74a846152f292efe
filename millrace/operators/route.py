"""Fan-in, fan-out, partitioning, switching, splitting, dead letters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.envelope import (
    ERR, META, PARTITION_INDEX, PARTITION_STRATEGY, PARTITION_TOTAL, PROCESSOR, ROUTE, TIMESTAMP, TS, error_struct, is_error, is_success, payload, with_metadata)
from millrace.functions.fnv import with_fnv1a_mod

from .flow import number_successes


def fan_in(*inputs: DataFrame) -> DataFrame:
    """All rows of all inputs; the order within each stays in its order columns."""
    if not inputs:
        raise ValueError("no inputs")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)


def fan_out(df: DataFrame, count: int, persist: bool = False) -> list[DataFrame]:
    """``count`` outputs of the same rows; ``persist`` where computing them again costs more than keeping them."""
    if count < 1:
        raise ValueError("count must be positive")
    df = df.persist() if persist else df
    return [df] * count


def fan_out_long(df: DataFrame, count: int) -> DataFrame:
    """The outputs as one table: every row for each ``branch`` from 0."""
    return df.withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def _count(n: int) -> int:
    if n < 1:
        raise ValueError("the number of partitions must be positive")
    return n


def _partitioned(df: DataFrame, index: Column, n: int, strategy: str, name: str) -> DataFrame:
    safe = F.when(is_error(), 0).when((index >= 0) & (index < n), index).otherwise(0).cast("int")
    df = df.withColumn(PARTITION_INDEX, safe)
    return with_metadata(df, {
        PARTITION_INDEX: F.col(PARTITION_INDEX), PARTITION_TOTAL: F.lit(n), PARTITION_STRATEGY: F.when(is_error(), "error").otherwise(strategy),
        PROCESSOR: F.lit(name), TIMESTAMP: F.col(TS)})


def partition_hash(df: DataFrame, key: str, n: int, name: str = "partition") -> DataFrame:
    """``partition_index`` = FNV-1a of the key modulo ``n`` for successes, 0 for errors. Keys of types other than string,
    int and long are labelled as a custom strategy."""
    kind = df.schema[key].dataType.simpleString()
    rows = with_fnv1a_mod(df, key, _count(n), "_fnv")
    return _partitioned(rows, F.coalesce("_fnv", F.lit(0)), n, "hash" if kind in ("string", "int", "bigint") else "custom", name).drop("_fnv")


def partition_round_robin(df: DataFrame, n: int, name: str = "partition") -> DataFrame:
    """Successes in turn from partition 0; errors go to 0 and take no turn."""
    return round_robin_by_number(number_successes(df, []), n, name)


def round_robin_by_number(df: DataFrame, n: int, name: str = "partition") -> DataFrame:
    """The same of rows whose successes are numbered from 1 in ``_n``."""
    return _partitioned(df, (F.col("_n") - 1) % _count(n), n, "round_robin", name).drop("_n")


def partition_custom(df: DataFrame, index: Column, n: int, name: str = "partition") -> DataFrame:
    """Any expression as the index; null and out-of-range ones go to 0."""
    return _partitioned(df, index, _count(n), "custom", name)


def partition_stats(df: DataFrame) -> DataFrame:
    """``partition_index, n, share`` of a partitioned table."""
    counts = df.groupBy(PARTITION_INDEX).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("t"))), F.lit(True)).select(PARTITION_INDEX, "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


def partition_balance(df: DataFrame, n: int) -> DataFrame:
    """One row: mean and deviation of the rows of ``n`` partitions, empty ones included, and their ratio (0: even)."""
    own = [F.count_if(F.col(PARTITION_INDEX) == i).cast("double").alias(f"c{i}") for i in range(_count(n))]
    sizes = df.agg(*own).select(F.array(*[F.col(f"c{i}") for i in range(n)]).alias("sizes"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    mean = total(F.col("sizes")) / n
    out = sizes.withColumn("mean", mean)
    out = out.withColumn("deviation", F.sqrt(total(F.transform("sizes", lambda x: (x - F.col("mean")) * (x - F.col("mean")))) / n))
    return out.select(F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), F.round(F.when(F.col("mean") > 0, F.col("deviation") / F.col("mean")), 6).alias("balance"))


class Switch:
    """Routes successes by a key expression to the routes added; errors have a channel of their own."""

    ERROR = "__error__"

    def __init__(self, key: Column, default: str | None = None, fails: Column | None = None, name: str = "switch"):
        self.key, self.default, self.fails, self.name, self._routes = key, default, fails, name, []

    def add_route(self, key: str) -> Switch:
        if key not in self._routes:
            self._routes.append(key)
        return self

    def remove_route(self, key: str) -> bool:
        there = key in self._routes
        self._routes = [r for r in self._routes if r != key]
        return there

    def has_route(self, key: str) -> bool:
        return key in self._routes

    def route_keys(self) -> list[str]:
        return list(self._routes)

    def process(self, df: DataFrame) -> DataFrame:
        """Rows with their ``route``; what has no route goes to the default one, or is dropped without."""
        if self.default is not None and self.default not in self._routes:
            raise ValueError(f"the default route {self.default!r} has not been added")
        key = self.key.cast("string")
        route = F.when(key.isin(*self._routes), key) if self._routes else F.lit(None).cast("string")
        route = F.coalesce(route, F.lit(self.default))
        if self.fails is not None:  # a key that can't be computed is an error of this operator
            item = F.struct(*[F.col(c) for c in payload(df)]).cast(df.schema[ERR].dataType["item"].dataType)
            df = df.withColumn(ERR, F.when(is_error(), F.col(ERR)).when(F.coalesce(self.fails, F.lit(False)), error_struct(item, F.lit("predicate panic"), self.name, F.col(TS))))
        out = df.withColumn(ROUTE, F.when(is_error(), F.lit(self.ERROR)).otherwise(route)).filter(F.col(ROUTE).isNotNull())
        return with_metadata(out, {ROUTE: F.when(is_success(), F.col(ROUTE)), PROCESSOR: F.lit(self.name), TIMESTAMP: F.col(TS)})

    def outputs(self, df: DataFrame) -> dict[str, DataFrame]:
        """A table for each route and for errors."""
        routed = self.process(df)
        return {r: routed.filter(F.col(ROUTE) == r) for r in [*self._routes, self.ERROR]}


def first_match(cases: dict[str, Column], default: str | None = None) -> Column:
    """The name of the first case that holds."""
    route = None
    for name, predicate in cases.items():
        route = F.when(predicate, name) if route is None else route.when(predicate, name)
    if route is None:
        return F.lit(default)
    return route.otherwise(F.lit(default))


def router(df: DataFrame, routes: dict[str, Column], default: str | None = None, all_matches: bool = False,
           processors: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Successes with the ``route`` of the first predicate that holds, or a row for each one that does; unmatched rows go
    to the default or are dropped; errors pass with a null route. ``processors`` run on their routes' rows."""
    if all_matches:
        names = F.filter(F.array(*[F.when(p, F.lit(k)) for k, p in routes.items()]), lambda x: x.isNotNull())
        names = F.when(F.size(names) == 0, F.array(F.lit(default)) if default is not None else F.array().cast("array<string>")).otherwise(names)
        good = df.filter(is_success()).withColumn(ROUTE, F.explode(names))
    else:
        good = df.filter(is_success()).withColumn(ROUTE, first_match(routes, default)).filter(F.col(ROUTE).isNotNull())
    if processors:
        own = [good.filter(F.col(ROUTE) == k).transform(p) for k, p in processors.items()]
        good = fan_in(*own, good.filter(~F.col(ROUTE).isin(*processors)))
    return good.unionByName(df.filter(is_error()).withColumn(ROUTE, F.lit(None).cast("string")), allowMissingColumns=True)


def route_stats(df: DataFrame) -> DataFrame:
    """``route, n``: matches of each route."""
    return df.filter(F.col(ROUTE).isNotNull()).groupBy(ROUTE).agg(F.count("*").alias("n"))


def split(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Successes for which the predicate holds, and those for which it doesn't (null included); errors go to the second."""
    yes = F.coalesce(predicate, F.lit(False))
    return df.filter(is_success() & yes), df.filter(is_error() | ~yes)


def split_stats(df: DataFrame, predicate: Column) -> DataFrame:
    """``true_count, false_count, true_ratio`` of successes."""
    yes = F.coalesce(predicate, F.lit(False))
    return df.filter(is_success()).agg(F.count_if(yes).alias("true_count"), F.count_if(~yes).alias("false_count"), F.round(F.avg(yes.cast("int")), 6).alias("true_ratio"))


def dead_letter(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Successes and failures. Nothing is dropped, as no consumer can block: the dropped count is 0."""
    return df.filter(is_success()), df.filter(is_error())


def dead_letter_items(df: DataFrame, attempts: Column | None = None) -> DataFrame:
    """Failures as dead letters: ``item, error, timestamp, attempts, metadata``."""
    e = F.col(ERR)
    return df.filter(is_error()).select(e["item"].alias("item"), e["message"].alias("error"), e["ts"].alias("timestamp"),
                                        (F.lit(1) if attempts is None else attempts).alias("attempts"), F.col(META).alias("metadata"))
