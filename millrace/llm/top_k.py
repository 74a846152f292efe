"""Exact top-k by inner product: Fagin's threshold algorithm over sorted lists, one for each dimension.

Vectors are dealt into shards of bounded size. A shard sorts its rows once for every dimension; a query walks down all
lists side by side, from the end that its sign favours, scores what it meets for the first time, and stops when not even a
row that stood at the present depth of every list could reach its k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, prepare

#: Rows of a shard, about; queries stream past it and are never held together.
SHARD_ROWS = 8192
#: Codes of this size and more raise.
MAX_CODE = 1 << 62


class SortedLists:
    """Rows of a shard, and their places in the order of each dimension."""

    def __init__(self, row: np.ndarray, name: np.ndarray, nameless: np.ndarray, codes: np.ndarray):
        self.row, self.name, self.nameless, self.codes = row, name, nameless, codes
        order = np.argsort(codes, axis=0, kind="stable")
        self.values = np.ascontiguousarray(np.take_along_axis(codes, order, 0).T)
        self.order = np.ascontiguousarray(order.T.astype(np.int32))
        self.largest = float(np.abs(codes).max(initial=0))
        self.exact = codes.astype(np.float64)

    def scores(self, which: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Whole inner products: by doubles where all sums stay below 2^53, else by integers of any size."""
        if self.largest * float(np.abs(query).max(initial=0)) * len(query) < 2**53:
            return (self.exact[which] @ query.astype(np.float64)).astype(np.int64)
        sums = self.codes[which].astype(object) @ query.astype(object)
        if any(abs(int(s)) >= 2**63 for s in sums):
            raise OverflowError("a score doesn't fit 64 bits")
        return sums.astype(np.int64)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the best ``k`` rows but the query's own, the smaller name first among equal scores, and how
        many rows were scored."""
        n = len(self.row)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        weights = np.concatenate([query[up], query[down]]).astype(object)
        best, points = np.zeros(0, np.int64), np.zeros(0, np.int64)
        met = np.zeros(n, bool)
        depth, done = 0, max(k, n // 64, 1)
        while depth < n:
            if not len(weights):
                done = n  # every score is 0: no list tells rows apart
            done = min(done, n)
            fresh = np.zeros(n, bool)
            if len(weights):
                fresh[self.order[up, n - done : n - depth].ravel()] = True
                fresh[self.order[down, depth:done].ravel()] = True
            else:
                fresh[:] = True
            fresh &= ~met
            met |= fresh
            fresh &= self.row != own
            new = np.flatnonzero(fresh)
            score = self.scores(new, query)
            if len(best) == k:
                near = score >= points[-1]
                new, score = new[near], score[near]
            best, points = np.concatenate([best, new]), np.concatenate([points, score])
            sort = np.lexsort((self.name[best], self.nameless[best], -points))[:k]
            best, points = best[sort], points[sort]
            depth, done = done, 2 * done
            if len(best) == k and depth < n:
                bound = int((weights * np.concatenate([self.values[up, n - depth], self.values[down, depth - 1]])).sum())
                if bound < int(points[-1]):  # an equal score might still come with a smaller name
                    break
        return best, points, int(met.sum())


def quantized(c: Column, scale: int = 256) -> Column:
    """Components as whole numbers, the floor of ``scale`` times each in double precision; null where a vector is null or holds
    null or non-finite components."""
    sound = c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    small = lambda x: F.when(F.abs(x) < float(MAX_CODE), F.floor(x)).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))
    return F.when(sound, F.transform(c, lambda x: small(x.cast("double") * scale)))


def top_k(vectors: DataFrame, asks: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row where ``asks`` holds, the ``k`` other rows of largest inner product of the
    whole-number codes, ranks from 1, the smaller id first among equal scores, all where there are fewer.

    Vectors that are null or hold null or non-finite components take no part; vectors of different lengths don't meet; empty
    ones score 0. A row is left out of its own answer, rows that repeat its id are not; each repeated query is answered. A
    null id is the largest. Ids are whole numbers. An empty table gives no rows; other columns are not read. Scores that do
    not fit 64 bits raise.
    """
    spark = vectors.sparkSession
    prepare(spark)
    kept = vectors.select(F.col(f"`{id_col}`").cast("long").alias("name"), quantized(F.col(f"`{vec_col}`")).alias("code"), F.coalesce(asks, F.lit(False)).alias("ask"))
    kept = kept.filter(F.col("code").isNotNull()).withColumn("row", F.monotonically_increasing_id())
    coded = Table(kept, "codes").df  # the row numbers stay what they are
    shards = max(1, -(-coded.count() // shard_rows))
    parts = max(1, -(-spark.sparkContext.defaultParallelism // shards))  # few shards: each is built for several groups of queries
    at = [F.size("code").alias("dims")]
    base = coded.select(*at, F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), "row", "name", "code")
    each = coded.filter("ask").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    each = each.select(*at, "shard", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "row", "name", "code")
    rows = base.unionByName(each).repartition("dims", "shard", "part").sortWithinPartitions("dims", "shard", "part", "kind", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, lists = None, [], None
        for batch in batches:
            key = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(4)])
            ends = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(ends[:-1], ends[1:]):
                if a == b:
                    continue
                *group, kind = key[:, a].tolist()
                if group != now:
                    now, held, lists = group, [], None
                cut = batch.slice(a, b - a)
                name = cut.column(5)
                codes = np.asarray(cut.column(6).flatten()).astype(np.int64).reshape(b - a, group[0])
                block = (np.asarray(cut.column(4)), np.asarray(name.fill_null(0)), np.asarray(name.is_null()), codes)
                if kind == 0:
                    held.append(block)
                    continue
                if lists is None:
                    if not held:
                        continue
                    lists, held = SortedLists(*(np.concatenate(x) for x in zip(*held))), []
                found: list[tuple] = []
                for i in range(b - a):
                    best, points, _ = lists.top(codes[i], int(block[0][i]), k)
                    found.append((np.full(len(best), i), best, points))
                who, best, points = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(block[0][who]), pa.array(block[1][who], mask=block[2][who]), pa.array(lists.name[best], mask=lists.nameless[best]), pa.array(lists.row[best]), pa.array(points)],
                                                 names=["ask", "query_id", "vec_id", "row", "score"])

    found = rows.mapInArrow(run, "ask long, query_id long, vec_id long, row long, score long")
    w = Window.partitionBy("ask").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
