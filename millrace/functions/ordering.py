"""Global order numbers without a global task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: str, tie: str, name: str = "_n", where: Column | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``: 1, 2, 3, ... in the order of two columns, over the rows where ``where`` holds (else null).

    Quantiles of the order column (a number or timestamp) cut the rows into ranges; rows are numbered in their range,
    and a count of each range, a row each, gives the offsets. Rows with one value of ``order`` share a range.
    """
    spark = df.sparkSession
    kind = df.schema[order].dataType.simpleString()
    x = F.col(order)
    x = F.unix_micros(x.cast("timestamp")) if kind.startswith(("timestamp", "date")) else x
    chosen = F.lit(True) if where is None else where
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = df.select(F.percentile_approx(x, [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).first()[0] or []
    marks = sorted(set(marks))

    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x > F.lit(marks[mid]), place(mid + 1, hi)).otherwise(place(lo, mid))

    cut = df.withColumns({"_range": place(0, len(marks)), "_on": F.coalesce(chosen, F.lit(False))})
    counts = dict(cut.groupBy("_range").agg(F.count_if("_on").alias("n")).collect())  # one row a range
    before, offsets = 0, []
    for r in range(len(marks) + 1):
        offsets.append(before)
        before += counts.get(r, 0)
    w = Window.partitionBy("_range").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("_range") + 1) + F.count_if("_on").over(w)
    return cut.withColumn(name, F.when(F.col("_on"), number)).drop("_range", "_on")


#: Ends of the whole numbers that bounds are padded with; the quantile sketch's accuracy, which its memory follows; bounds that a
#: tree of comparisons is made of.
LEAST, MOST, MAX_ACCURACY, MAX_TREE = -(2**63) + 1, 2**63 - 1, 200_000, 256


def cut_points(df: DataFrame, columns: list[str], ranges: int, deeper: int = 0) -> tuple[list[tuple[int, ...]], set[int]]:
    """Upper ends of about ``ranges`` ranges of near-equal size, over rows compared by whole-number columns in turn, and the
    values of the first column that fill more than a range. A value that fills several is cut by the next column, and so on:
    no value makes a range of its own that is larger than the others, unless rows are equal in all columns. With
    ``deeper``, only such values of the first so many columns are cut. A job a column in use, its result a row a range at most.
    Quantiles are doubles: values of 2^53 and more are told apart less finely.
    """
    points = lambda n: [i / n for i in range(1, n)]
    pad = lambda head, end: (*head, *[end] * (len(columns) - len(head)))
    accuracy = lambda n: min(100 * n, MAX_ACCURACY)
    marks = df.agg(F.percentile_approx(columns[0], points(ranges), accuracy(ranges))).first()[0] if ranges > 1 else None
    found, full = {(): marks or []}, set()
    bounds: set[tuple[int, ...]] = set()
    for depth in range(len(columns)):
        wide: dict[tuple[int, ...], int] = {}
        for head, values in found.items():
            for v in set(values):
                times = values.count(v)
                if times > 1:
                    wide[(*head, v)] = times
                    full |= {v} if not head else set()
                    if v > LEAST:
                        bounds.add(pad((*head, v - 1), MOST))
                if times > 1 or depth >= deeper:
                    bounds.add(pad((*head, v), MOST))
        if not wide or depth + 1 == len(columns):
            break
        most = max(wide.values()) + 1
        head_is = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c) == x for c, x in zip(columns, h)]) for h in wide])
        rows = df.filter(head_is).groupBy(*columns[: depth + 1]).agg(F.percentile_approx(columns[depth + 1], points(most), accuracy(most)).alias("marks")).collect()
        thin = lambda marks, n: [marks[round(i * (len(marks) + 1) / (n + 1)) - 1] for i in range(1, n + 1)]
        found = {h: thin(r["marks"], wide[h]) for r in rows if (h := tuple(r)[:-1]) in wide and r["marks"]}
        deeper = 0
    return sorted(bounds), full


def range_of(bounds: list[tuple[int, ...]], columns: list[str]) -> Column:
    """How many of the bounds lie below the row: its range. A binary search: a tree of comparisons, in generated code, or, for
    more than MAX_TREE bounds, in a constant array."""
    if not bounds:
        return F.lit(0)

    def above(b: tuple[int, ...], i: int = 0) -> Column:
        c = F.col(columns[i])
        if all(x == MOST for x in b[i + 1 :]):
            return c > b[i]
        return (c > b[i]) | ((c == b[i]) & above(b, i + 1))

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(above(bounds[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    if len(bounds) <= MAX_TREE:
        return tree(0, len(bounds))
    names = [f"c{i}" for i in range(len(columns))]
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    full = bounds + [tuple([MOST] * len(columns))] * (2 * steps[0] - 1 - len(bounds))
    struct = lambda b: "named_struct(" + ", ".join(f"'{n}', {x}L" for n, x in zip(names, b)) + ")"
    marks = F.expr("array(" + ", ".join(map(struct, full)) + ")")
    row = F.struct(*[F.col(c).alias(n) for n, c in zip(names, columns)])
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.element_at(marks, at + step) < row, at + step).otherwise(at))


def estimated_bytes(df: DataFrame) -> int:
    """What Spark's own statistics say of the size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def with_neighbour(df: DataFrame, us: str, tie: str, name: str, after: bool = True, ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``: the whole number ``us`` of the next row (or the one before) in the order of ``us`` and ``tie``, over all rows.
    Quantiles cut the order into ranges; a range's last row looks at the first of the next range that has rows, of which a
    row a range is collected."""
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = df.schema[tie].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    rows = df.withColumns({"_u": F.col(us), "_q": F.coalesce(F.col(tie).cast("long"), F.lit(LEAST)) if whole else F.lit(0).cast("long")})
    bounds, _ = cut_points(rows.select("_u", "_q"), ["_u", "_q"], ranges)
    cut = rows.withColumn("_range", range_of(bounds, ["_u", "_q"]))
    edges = dict(cut.groupBy("_range").agg((F.min if after else F.max)("_u")).collect())  # one row a range
    beyond, seen = [None] * (len(bounds) + 1), None
    for r in reversed(range(len(beyond))) if after else range(len(beyond)):
        beyond[r] = seen
        seen = edges.get(r, seen)
    w = Window.partitionBy("_range").orderBy(us, tie)
    own = F.lead("_u").over(w) if after else F.lag("_u").over(w)
    other = F.element_at(F.array(*[F.lit(x).cast("long") for x in beyond]), F.col("_range") + 1)
    return cut.withColumn(name, F.coalesce(own, other)).drop("_u", "_q", "_range")
