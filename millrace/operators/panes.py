"""Sliding windows by panes: every row is summed up once, in the pane of the greatest common divisor of size and slide, and
windows merge their panes. What is exchanged is rows of panes, however much the windows overlap.

An aggregate that can be merged is a ``Mergeable``: partial results of a pane, how partial results become one, and the
value of the merged ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.envelope import SEQ, TS, WINDOW_END, WINDOW_START, from_micros, is_error, is_success, micros

#: Panes of a block, at least; blocks are worked on side by side and a pane is in two at most.
BLOCK = 1024


@dataclass(frozen=True)
class Mergeable:
    """``partial``: aggregates over rows; ``merge``: for each of them, the aggregate over its partial results; ``final``: the value, of
    the merged columns by name."""

    partial: dict[str, Column]
    merge: dict[str, Callable[[Column], Column]]
    final: Callable[[dict[str, Column]], Column]


def count(where: Column | None = None) -> Mergeable:
    own = F.count("*") if where is None else F.count_if(where)
    return Mergeable({"n": own}, {"n": F.sum}, lambda m: F.coalesce(m["n"], F.lit(0).cast("long")))


def total(c: Column) -> Mergeable:
    """A sum; exact for decimals and whole numbers."""
    return Mergeable({"s": F.sum(c)}, {"s": F.sum}, lambda m: m["s"])


def least(c: Column) -> Mergeable:
    return Mergeable({"x": F.min(c)}, {"x": F.min}, lambda m: m["x"])


def greatest(c: Column) -> Mergeable:
    return Mergeable({"x": F.max(c)}, {"x": F.max}, lambda m: m["x"])


def mean(c: Column) -> Mergeable:
    return Mergeable({"s": F.sum(c), "n": F.count(c)}, {"s": F.sum, "n": F.sum}, lambda m: F.when(m["n"] > 0, m["s"].cast("double") / m["n"]))


def earliest(c: Column) -> Mergeable:
    """The value of the first row of arrival."""
    return Mergeable({"x": F.min(F.struct(F.col(TS), F.col(SEQ), c.alias("v")))}, {"x": F.min}, lambda m: m["x"]["v"])


def latest(c: Column) -> Mergeable:
    return Mergeable({"x": F.max(F.struct(F.col(TS), F.col(SEQ), c.alias("v")))}, {"x": F.max}, lambda m: m["x"]["v"])


def distinct(c: Column, log_k: int = 12) -> Mergeable:
    """About how many different values, by a sketch of 2 to the ``log_k`` buckets: relative standard error 1.04 over the root of
    that number."""
    return Mergeable({"h": F.hll_sketch_agg(c, log_k)}, {"h": F.hll_union_agg}, lambda m: F.coalesce(F.hll_sketch_estimate(m["h"]), F.lit(0).cast("long")))


def quantiles(c: Column, points: tuple[float, ...], k: int = 200) -> Mergeable:
    """Quantiles by a sketch of bounded size (``k`` 200: within 0.0165 of the rank with 0.99 certainty); exact up to ``k`` values."""
    return Mergeable({"q": F.kll_sketch_agg_double(c.cast("double"), k)}, {"q": lambda x: F.kll_merge_agg_double(x, k)},
                     lambda m: F.when(F.kll_sketch_get_n_double(m["q"]) > 0, F.kll_sketch_get_quantile_double(m["q"], F.array(*map(F.lit, points)))))


def _partial(aggregates: dict[str, Mergeable]) -> list[Column]:
    return [a.alias(f"_{k}_{p}") for k, m in aggregates.items() for p, a in m.partial.items()]


def _merged(aggregates: dict[str, Mergeable]) -> dict[str, Column]:
    return {f"_{k}_{p}": f(F.col(f"_{k}_{p}")) for k, m in aggregates.items() for p, f in m.merge.items()}


def _final(aggregates: dict[str, Mergeable]) -> list[Column]:
    return [m.final({p: F.col(f"_{k}_{p}") for p in m.partial}).alias(k) for k, m in aggregates.items()]


def sliding_aggregates(df: DataFrame, size: int, slide: int, aggregates: dict[str, Mergeable], keys: list[str] | None = None, anchor: int | None = None,
                       block: int = BLOCK) -> DataFrame:
    """A row for each window of ``size`` microseconds (of each key): ``window_start, window_end`` and the aggregates over all its rows.
    Windows begin every ``slide`` from ``anchor``, by default from the first row (of each key), and exist if their first slide
    holds a row. Rows without a time are in none."""
    if size <= 0 or slide <= 0:
        raise ValueError("a window's size and slide must be positive")
    if slide > size:
        raise ValueError("a slide longer than the size leaves gaps")
    keys, pane = keys or [], gcd(size, slide)
    reach, step = size // pane, slide // pane
    block = -(-max(block, 4 * reach) // step) * step
    rows = df.withColumn("_us", micros(F.col(TS))).filter(F.col("_us").isNotNull())
    if anchor is not None:
        rows = rows.withColumn("_first", F.lit(anchor).cast("long"))
    elif keys:
        first = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("_us").alias("_first"))
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        rows = rows.join(first, same).drop(*[f"_k{i}" for i in range(len(keys))])
    else:
        rows = rows.join(F.broadcast(rows.agg(F.min("_us").alias("_first"))), F.lit(True))  # one row
    rows = rows.withColumn("_p", F.expr(f"(_us - _first - pmod(_us - _first, {pane})) div {pane}"))
    panes = rows.groupBy(*keys, "_first", "_p").agg(*_partial(aggregates)).withColumn("_own", F.lit(True))
    parts = list(_merged(aggregates))
    if step > 1:  # a window may begin with an empty pane: a row without results marks where
        empty = panes.filter(F.col("_p") % step != 0).withColumn("_p", F.col("_p") - F.pmod(F.col("_p"), F.lit(step)))
        kinds = {f.name: f.dataType for f in panes.schema}
        panes = panes.unionByName(empty.withColumns({c: F.lit(None).cast(kinds[c]) for c in parts}))
    # A pane goes to its block, and to the one before if windows that begin there reach it.
    own = F.floor(F.col("_p") / block)
    both = F.when(F.col("_p") - own * block < reach - 1, F.array(own, own - 1)).otherwise(F.array(own))
    dealt = panes.withColumn("_block", F.explode(both)).withColumn("_own", F.col("_block") == own)
    within = Window.partitionBy(*keys, "_first", "_block").orderBy("_p")
    ahead = within.rangeBetween(0, reach - 1)
    out = dealt.withColumns({c: a.over(ahead) for c, a in _merged(aggregates).items()})
    if step > 1:
        out = out.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_first", "_block", "_p").orderBy("_p"))).filter((F.pmod(F.col("_p"), F.lit(step)) == 0) & (F.col("_rn") == 1))
    start = F.col("_first") + F.col("_p") * pane
    return out.filter("_own").select(*keys, from_micros(start).alias(WINDOW_START), from_micros(start + size).alias(WINDOW_END), *_final(aggregates))


def collect_sliding(df: DataFrame, size: int, slide: int, aggregates: dict[str, Mergeable] | None = None, keys: list[str] | None = None, anchor: int | None = None) -> DataFrame:
    """What ``collect_windows`` gives of ``sliding``, by panes: ``item_count, success_count, error_count`` of each window, and more."""
    counts = {"item_count": count(), "success_count": count(is_success()), "error_count": count(is_error())}
    return sliding_aggregates(df, size, slide, counts | (aggregates or {}), keys, anchor)


def interval_sketches(df: DataFrame, interval: int, aggregates: dict[str, Mergeable], keys: list[str] | None = None) -> DataFrame:
    """The partial results of each interval (and key), a row each, to be kept: ``start_ts`` and columns for ``merge_intervals``. Of
    bounded size where the partial results are."""
    us = micros(F.col(TS))
    rows = df.withColumn("_w", us - F.pmod(us, F.lit(interval)))
    return rows.groupBy(*(keys or []), from_micros(F.col("_w")).alias("start_ts")).agg(*_partial(aggregates))


def merge_intervals(kept: DataFrame, aggregates: dict[str, Mergeable], by: list[str] | None = None) -> DataFrame:
    """The values over all kept intervals of each group, whatever range of intervals a filter has left."""
    return kept.groupBy(*(by or [])).agg(*[a.alias(c) for c, a in _merged(aggregates).items()]).select(*(by or []), *_final(aggregates))
