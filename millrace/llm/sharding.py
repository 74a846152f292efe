"""Sharding by sampled splitters: near-equal bytes a shard, JVM-side only.

Records are ordered by a hash of their text (equal texts lie together, order is otherwise random, so each shard is
a random sample of the corpus). Size-weighted samples of that key give quantile boundaries; records are
range-partitioned by them, ranges that turn out overfull are sampled again and subdivided, and exact running sums
over the ranges place every record. The sums are exact, so sampling only decides how even the tasks are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table

#: Columns of the sort key, most significant first.
KEY = ("k0", "k1", "k2")
SAMPLES_PER_RANGE = 24
MAX_RANGES = 1024
MAX_ROUNDS = 4


def _uniform(seed: int) -> Column:
    """A number in [0, 1) that depends on the record's key only."""
    return F.shiftrightunsigned(F.xxhash64(*[F.col(k) for k in KEY], F.lit(seed)), 11) / F.lit(float(1 << 53))


def _at_least(bound: tuple) -> Column:
    """Whether the record's key is at or after ``bound``."""
    (a, b, c), (x, y, z) = (F.col(k) for k in KEY), (F.lit(v).cast("long") for v in bound)
    return (a > x) | ((a == x) & ((b > y) | ((b == y) & (c >= z))))


def _range_of(bounds: list[tuple], lo: int = 0, hi: int | None = None) -> Column:
    """Number of bounds at or before the key, as a balanced tree of comparisons (log2 of them a record)."""
    hi = len(bounds) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(_at_least(bounds[mid]), _range_of(bounds, mid + 1, hi)).otherwise(_range_of(bounds, lo, mid))


def _sample(rows: DataFrame, rate: Column, seed: int) -> list[tuple]:
    """(key..., range, weight) of a size-weighted sample; its expected size is the number wanted, whatever the input's.
    Records above the sampling rate of 1 weigh more instead."""
    return [tuple(r) for r in rows.filter(_uniform(seed) < rate).select(*KEY, "range", F.greatest(rate, F.lit(1.0)).alias("weight")).collect()]


def _quantiles(sample: list[tuple], parts: int) -> list[tuple]:
    """Boundaries that cut the weight of a sample into ``parts`` equal parts."""
    ordered, out, total, run = sorted(sample), [], sum(s[-1] for s in sample), 0.0
    for s in ordered:
        before, run = run, run + s[-1]
        if int(before * parts / total) != int(run * parts / total):
            out.append(s[:3])
    return out


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                   ranges: int | None = None) -> DataFrame:
    """One row per record: ``doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null)``.

    size: UTF-8 bytes of the text (none for null) plus 16. Shard boundaries are multiples of total/n_shards on the
    axis of summed sizes; a record goes where its middle lies, so shards differ from the mean by at most one
    record's size. Slots count from 0 in each shard without gaps, in key order. Copies of a text follow one another;
    groups larger than a range are subdivided by a hash of doc_id, and rows equal in all columns by their place in
    the input. Null ids and texts are ordinary values; an empty input gives no rows; other columns are ignored.
    Bounds: at most MAX_RANGES ranges, about SAMPLES_PER_RANGE sampled keys for each, reach the driver.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    base = Table(docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(16)).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.crc32(F.lit("").cast("binary"))).alias("text_crc32"),
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("k0"),
        F.xxhash64(F.col(f"`{id_col}`"), F.lit(1)).alias("k1"),
        F.monotonically_increasing_id().alias("k2")), "shard-base")
    rows = base.df
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if ranges is None:
        ranges = max(4 * n_shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = max(1, min(ranges, MAX_RANGES, n or 1))
    limit = 2 * total / ranges
    bounds: list[tuple] = []
    full = {0: total}
    for turn in range(MAX_ROUNDS):
        # Draw from the overfull ranges only; the first round has one range, which is everything.
        wanted = {r: max(2, min(ranges, round(b * ranges / max(total, 1)))) for r, b in full.items()}
        rate = F.lit(0.0)
        for r, b in full.items():
            rate = F.when(F.col("range") == r, F.col("size") * F.lit(wanted[r] * SAMPLES_PER_RANGE / max(b, 1))).otherwise(rate)
        placed = rows.withColumn("range", _range_of(bounds))
        drawn = _sample(placed.filter(F.col("range").isin(*full)) if turn else placed, rate, turn)
        found = {q for r in full for q in _quantiles([s for s in drawn if s[3] == r], wanted[r])} - set(bounds)
        bounds = sorted({*bounds, *found})
        sums = rows.withColumn("range", _range_of(bounds)).groupBy("range").agg(
            F.sum("size").alias("b"), F.count("*").alias("n"), F.max("size").alias("m")).collect()
        full = {s["range"]: s["b"] for s in sums if s["b"] > limit and s["n"] > 1 and s["b"] > 2 * s["m"]}
        if not full or not found or len(bounds) >= MAX_RANGES:
            break
    # Exact places: sums over whole ranges come from the driver (one row a range), running sums from each range.
    sums = sorted(sums)
    before_b, before_n, b, c = [], [], 0, 0
    for s in sums:
        before_b.append(b)
        before_n.append(c)
        b, c = b + s["b"], c + s["n"]
    offsets = spark.createDataFrame(
        [(s["range"], x, y) for s, x, y in zip(sums, before_b, before_n)], "range int, before_b long, before_n long")
    w = Window.partitionBy("range").orderBy(*KEY)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (rows.withColumn("range", _range_of(bounds))
              .withColumns({"run": F.sum("size").over(upto), "rn": F.row_number().over(w)})
              .join(F.broadcast(offsets), "range")
              .select("doc_id", "size", "text_crc32", (F.col("before_n") + F.col("rn")).alias("place"),
                      F.least(F.lit(n_shards - 1), F.expr(
                          f"int(((2 * (before_b + run) - size) * {n_shards}) div (2 * {max(total, 1)}))")).alias("shard")))
    placed = Table(ranked, "shard-places")
    base.drop()
    first = placed.df.groupBy("shard").agg(F.min("place").alias("first_place"))  # one row a shard
    return (placed.df.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("place") - F.col("first_place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))

