"""Which filter removes what, under every order of the filters.

A document is a set of failed filters, a number under 32; a table of 32 by 120 says at which step each order removes it.
Tasks add up removals by part, order, step and label, and their arrays are summed: no document is judged 120 times.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: Limits of the filters (fixed values): least words, least share of distinct words, most share of capitals, special characters.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SPECIAL = 50, 65, 5, b"#$%&*|"
#: Bytes of a text that are looked at together, and parts whose arrays a task holds before it hands them on.
PIECE, MAX_PARTS = 1 << 20, 1000
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def first_failures() -> np.ndarray:
    """The step, from 0, at which each order (columns) removes a set of failed filters (rows, bit 0 for A); 5: it stays."""
    failed = (np.arange(1 << STEPS)[:, None] >> np.arange(STEPS)) & 1
    place = np.array([[o.index(f) for f in FILTERS] for o in ORDERS])
    return np.where(failed[:, None, :] == 1, place[None], STEPS).min(axis=2)


def failed_filters(raw: bytes) -> int:
    """Bits of the filters A to D that a text fails, in UTF-8; whole texts, a piece after the other."""
    seen: set[bytes] = set()
    counts, words, at = np.zeros(256, np.int64), 0, 0
    while at < len(raw):
        end = at + PIECE
        cut = SPACE.search(raw, end) if end < len(raw) else None
        end = cut.start() if cut else len(raw)
        piece = raw[at:end]
        found = piece.split()  # bytes split at ASCII white space only
        words += len(found)
        seen.update(found)
        counts += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
        at = end
    points = len(raw) - int(counts[0x80:0xC0].sum())
    capitals = int(counts[ord("A") : ord("Z") + 1].sum())
    return ((words < LEAST_WORDS) | (100 * len(seen) < DISTINCT_PERCENT * words) << 1 | (100 * capitals > CAPITAL_PERCENT * points) << 2
            | bool(counts[list(SPECIAL)].any()) << 3)


def text_facts(docs: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """``doc_id, part, digest, mask``: the part (null: empty), a digest of the text (null: empty) that is equal only for equal
    texts, and the bits of the filters A to D that it fails."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()]
            digests = [hashlib.blake2b(x, digest_size=16).digest() for x in raws]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(map(failed_filters, raws), pa.int32())],
                                             names=["doc_id", "part", "digest", "mask"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def failure_sets(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, label, weight``: documents by part, failed filters (E among them) and label (1: good, 2: toxic, 3: both).

    Equal rows are counted before they are dealt by text, so a group of copies, however large, is a few rows of each part.
    """
    once = facts.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg((flag("quality") + 2 * flag("toxic")).alias("label"))
    rows = once.join(known, F.col("doc_id") == F.col("_id"), "left").withColumn("label", F.coalesce("label", F.lit(0)))
    groups = rows.groupBy("digest", "part", "mask", "label").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min("doc_id").alias("least"),
        F.min_by("n", "doc_id").alias("at_least"))
    # A row for each part and label of a text, not for each copy.
    groups = groups.withColumn("first", F.min("least").over(Window.partitionBy("digest")))
    original = F.col("nameless") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), original.alias("weight")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - original).alias("weight")))
    out = groups.select("part", "label", F.explode(both).alias("x")).select("part", F.col("x.mask").alias("mask"), "label", F.col("x.weight").alias("weight"))
    return out.filter("weight > 0")


def removals(sets: DataFrame) -> DataFrame:
    """``part, cell, n, good, toxic`` of ``part, mask, label, weight``: documents that each order removes at each step, and those
    that it keeps; ``cell`` is 6 times the order's number plus the step from 0 (5: kept)."""
    prepare(sets.sparkSession)
    table = first_failures()
    width = len(ORDERS) * (STEPS + 1)

    def hand_on(parts: dict[str, int], sums: np.ndarray) -> pa.RecordBatch:
        by = sums.reshape(-1, width, 4).astype(np.int64)[: len(parts)]
        columns = [by.sum(2), by[:, :, 1] + by[:, :, 3], by[:, :, 2] + by[:, :, 3]]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(parts), object), width), pa.string()), pa.array(np.tile(np.arange(width, dtype=np.int32), len(parts))),
                                           *(pa.array(c.ravel()) for c in columns)], names=["part", "cell", "n", "good", "toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, int] = {}
        sums = np.zeros(0)
        for batch in batches:
            names = batch.column(0).to_pylist()
            if len(parts) > MAX_PARTS:
                yield hand_on(parts, sums)
                parts, sums = {}, np.zeros(0)
            part = np.array([parts.setdefault(x, len(parts)) for x in names], np.int64)
            mask, label, weight = (np.asarray(batch.column(i)) for i in (1, 2, 3))
            cells = np.bincount((part * 32 + mask) * 4 + label, weights=weight)  # equal rows first
            there = np.flatnonzero(cells)
            part, mask, label = there // 128, there // 4 % 32, there % 4
            code = ((part[:, None] * len(ORDERS) + np.arange(len(ORDERS))) * (STEPS + 1) + table[mask]) * 4 + label[:, None]
            own = np.bincount(code.ravel(), weights=np.repeat(cells[there], len(ORDERS)), minlength=len(parts) * width * 4)
            own[: len(sums)] += sums
            sums = own
        if parts:
            yield hand_on(parts, sums)

    partial = sets.select("part", F.col("mask").cast("int"), F.col("label").cast("int"), F.col("weight").cast("double")).mapInArrow(run, "part string, cell int, n long, good long, toxic long")
    return partial.groupBy("part", "cell").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, ``filter_order`` and ``step`` (from 1): ``kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley`` of the filters A to E over whole texts.

    A null or empty text has no words and no characters: it fails A, and E if a smaller id has one too. Of equal texts the
    smallest id is the original, with all rows that repeat it; a null id is smaller than none and has none before it. A
    null part is the empty one. A document with several rows of labels is good, or toxic, if one of them says so; one without any or without id
    is neither. Very long texts are judged whole, in pieces; an empty table gives no rows; other columns are not read,
    whatever their names.
    """
    sums = removals(failure_sets(text_facts(docs), labels))
    order, step = F.floor(F.col("cell") / (STEPS + 1)).cast("int"), F.col("cell") % (STEPS + 1)
    rows = sums.withColumns({"filter_order": F.element_at(F.array(*map(F.lit, ORDERS)), order + 1), "step": (step + 1).cast("int")})
    rows = rows.withColumn("_f", F.substring("filter_order", F.col("step"), F.lit(1)))
    later = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(1, Window.unboundedFollowing)
    own = Window.partitionBy("part", "_f")  # 720 rows of a part: what a filter does first, and last, is what it does alone
    at = lambda s: F.max(F.when(F.col("step") == s, F.col("n"))).over(own)
    rows = rows.withColumn("kept", F.sum("n").over(later)).filter(F.col("step") <= STEPS)
    return rows.select("part", "filter_order", "step", "kept", F.col("n").alias("removed"), (at(1) - F.col("n")).alias("redundant"), at(STEPS).alias("unique_fails"),
                       F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("n").over(own).alias("shapley"))
