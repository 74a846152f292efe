"""Substring dedup by recompression.

Rounds of recompression name runs of equal symbols, then pairs of a left-class and a right-class symbol; names and
classes are hashes of what they stand for, so they are global without a dictionary, and a word sequence gets the
same interior symbols wherever it stands. For every window of words the symbols that depend on nothing outside it
are known exactly; the window's signature is the least-hashed triple of them. Equal windows have equal signatures, so
windows whose signature occurs once in the corpus are done with; the others are compared as wholes, by two names of
all their words that are made independently of each other and of the symbols, and each equal group keeps its first
occurrence. The text is exchanged once, to meet the places that stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, prepare
from .textkit import Words, blocks, byte_table, mix

_U = np.uint64
ROUNDS = 2
#: Symbols of a signature.
TRIPLE = 3
#: Signatures that occur more than once are sent to all tasks up to this many (8 bytes each); more are joined.
MAX_SENT = 6_000_000
#: Bits of a word's place next to a doc_id in one number; longer texts or larger ids use a pair instead.
PLACE_BITS = 24


def window_signatures(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words of the windows, their signatures, whether the signature's triple differs from that of the window
    before) for a block of texts."""
    at = np.flatnonzero(w.room() >= window)
    lo, hi = at.copy(), at + window
    sym, doc = w.name, w.doc
    if not len(at):
        return at, np.zeros(0, np.uint64), np.zeros(0, bool)
    for r in range(ROUNDS):
        # Runs. The window's first and last run may go on outside it.
        new = np.ones(len(sym), bool)
        new[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
        run = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(sym))).astype(np.uint64)
        sym, doc = np.where(length == 1, sym[begin], mix(sym[begin] * _U(0x9E6C63D0876A9A63) + length)), doc[begin]
        lo, hi = run[np.minimum(lo, len(run) - 1)] + 1, run[hi - 1]
        hi = np.maximum(hi, 1)
        # Pairs. A first symbol of the right class, or a last one of the left, may be paired with one outside.
        right = (mix(sym ^ _U(0xC2B2AE3D27D4EB4F + r)) >> _U(63)).astype(bool)
        second = np.zeros(len(sym), bool)
        second[1:] = right[1:] & ~right[:-1] & (doc[1:] == doc[:-1])
        index = np.cumsum(~second) - 1
        lo = np.minimum(lo, len(sym) - 1)
        lo, hi = index[lo] + right[lo], index[hi - 1] + right[hi - 1]
        hi = np.maximum(hi, 1)
        first = np.flatnonzero(~second)
        follow = np.append(second[1:], False)[first]
        nxt = np.minimum(first + 1, len(sym) - 1)
        sym, doc = np.where(follow, mix(sym[first] * _U(0xAEF17502108EF2D9) + sym[nxt]), sym[first]), doc[first]
    g = np.zeros(len(sym) + TRIPLE, np.uint64)
    for k in range(TRIPLE):
        n = max(len(sym) - k, 0)
        g[:n] = g[:n] * _U(0xD1342543DE82EF95) + sym[k:]
    g = mix(g)
    room = hi - TRIPLE - lo
    best, where = np.full(len(at), 0xFFFFFFFFFFFFFFFF, np.uint64), np.full(len(at), -1)
    for d in range(int(room.max(initial=-1)) + 1):
        i = np.minimum(lo + d, len(g) - 1)
        take = (room >= d) & (g[i] < best)
        best, where = np.where(take, g[i], best), np.where(take, i, where)
    bare = where < 0  # hardly any symbol of its own, as in long runs: the window stands for itself
    if bare.any():
        best[bare] = mix(w.grams(window)[at[bare]] ^ _U(0x60642E2A34326F15))
    fresh = np.ones(len(at), bool)
    fresh[1:] = (where[1:] != where[:-1]) | bare[1:] | (w.doc[at[1:]] != w.doc[at[:-1]])
    return at, best, fresh


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    i = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[i] == values


def kept_text(w: Words, gone: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words that stay, joined by one space in each text, and the bounds of the texts."""
    stay = np.flatnonzero(~gone)
    data = np.append(w.data, np.uint8(0x20))
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, w.start[stay], 1)
    np.add.at(edge, w.end[stay], -1)
    keep = np.cumsum(edge[:-1]) > 0
    followed = stay[:-1][w.doc[stay[1:]] == w.doc[stay[:-1]]] if len(stay) else stay
    data[w.end[followed]] = 0x20
    keep[w.end[followed]] = True
    starts = np.searchsorted(w.doc[stay], np.arange(len(w.first)))
    total = np.concatenate([[0], np.cumsum(w.end[stay] - w.start[stay] + np.isin(stay, followed, assume_unique=True))])
    return data[keep].tobytes(), total[starts]


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", max_sent: int = MAX_SENT,
                   with_text: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256`` and, ``with_text``, ``kept``.

    Words are runs of characters other than ASCII white space, unchanged. A word goes if it is covered by ``window``
    consecutive words that also start earlier: in a document of smaller id, or earlier in the same one. Windows are
    judged on the input. Null, empty and short texts have no windows; a null id is the smallest; rows that repeat a
    doc_id count as one document, so that what stands at the same place in both goes from neither. Windows are equal
    if they agree in two independent 64-bit names of their words and in the signature. Empty input, no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    is_word = byte_table("spaces")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w in blocks(batch.column(0), is_word):
                _, sig, fresh = window_signatures(w, window)
                yield pa.RecordBatch.from_arrays([pa.array(sig[fresh].view(np.int64))], names=["sig"])

    repeated = Table(src.select("text").mapInArrow(sign, "sig long").groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1").select("sig"), "repeated-signatures")
    few = repeated.df.limit(max_sent + 1).count() <= max_sent
    sent = None
    if few:
        sent = spark.sparkContext.broadcast(np.sort(repeated.df.toArrow()["sig"].to_numpy()))
        work = src.withColumn("own", F.lit(None).cast("array<bigint>"))
    else:
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, w in blocks(batch.column(1), is_word):
                    at, sig, fresh = window_signatures(w, window)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(w.doc[at[fresh]])), pa.array(sig[fresh].view(np.int64))], names=["doc_id", "sig"])

        own = src.mapInArrow(place, f"doc_id {kind}, sig long").join(repeated.df, "sig", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_set("sig")).alias("own"))
        own = Table(own, "own-signatures")  # of each document, the signatures of its own that occur elsewhere too
        work = src.join(own.df.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "own")

    def candidates(w: Words, own: list | None) -> tuple[np.ndarray, np.ndarray]:
        """First words and signatures of the windows with a repeated signature."""
        at, sig, _ = window_signatures(w, window)
        sig = sig.view(np.int64)
        if sent is not None:
            hit = _member(sig, sent.value)
        else:
            hit = np.zeros(len(sig), bool)
            bounds = np.searchsorted(w.doc[at], np.arange(len(w.first)))
            for i, x in enumerate(own):
                if x:
                    hit[bounds[i] : bounds[i + 1]] = _member(sig[bounds[i] : bounds[i + 1]], np.array(x, np.int64))
        return at[hit], sig[hit].view(np.uint64)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = None if sent is not None else batch.column(2).to_pylist()
            for a, b, w in blocks(batch.column(1), is_word):
                at, sig = candidates(w, own and own[a:b])
                names = [mix(w.grams(window)[at] ^ sig).view(np.int64), w.grams(window, w.second_names())[at].view(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, names), batch.column(0).slice(a, b - a).take(pa.array(w.doc[at])), pa.array((at - w.first[w.doc[at]]).astype(np.int32))], names=["name", "second", "doc_id", "start"])

    named = work.mapInArrow(name, f"name long, second long, doc_id {kind}, start int")
    if _packable(src):
        place_ = F.shiftleft(F.col("doc_id").cast("long"), PLACE_BITS) + F.col("start")
        first = named.groupBy("name", "second").agg(F.min(place_).alias("p")).select(
            F.shiftright("p", PLACE_BITS).cast(kind).alias("doc_id"), F.col("p").bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias("start"))
    else:
        first = named.groupBy("name", "second").agg(F.min(F.struct("doc_id", "start")).alias("p")).select("p.*")
    firsts = Table(first.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("start").alias("firsts")), "first-windows")
    joined = work.join(firsts.df.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "own", "firsts")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = None if sent is not None else batch.column(2).to_pylist()
            for a, b, w in blocks(batch.column(1), is_word):
                at, _ = candidates(w, own and own[a:b])
                own_firsts = batch.column(3).slice(a, b - a)
                stays = np.zeros(len(w.name) + 1, bool)
                lists = own_firsts.fill_null([])
                count = np.asarray(pc.list_value_length(lists), np.int64)
                places, doc = np.asarray(lists.flatten(), np.int64), np.repeat(np.arange(b - a), count)
                where = (w.first[doc] + places)[places < np.diff(w.first)[doc]]  # a repeated id may have a shorter text
                stays[where] = True
                at = at[~stays[at]]
                cover = np.zeros(len(w.name) + window + 1, np.int32)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                gone = np.cumsum(cover)[: len(w.name)] > 0
                text, bounds = kept_text(w, gone)
                removed = np.bincount(w.doc[gone], minlength=b - a)
                kept = [text[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
                out = [batch.column(0).slice(a, b - a), pa.array(np.diff(w.first), pa.int64()), pa.array(removed, pa.int64()),
                       pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
                yield pa.RecordBatch.from_arrays(out + [pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())] * with_text,
                                                 names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text])

    return joined.mapInArrow(remove, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def _packable(src: DataFrame) -> bool:
    """Whether ids and places fit in one number."""
    if src.schema["doc_id"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        return False
    big: Column = F.max(F.octet_length("text"))
    low, high, nulls, longest = src.agg(F.min("doc_id"), F.max("doc_id"), F.count_if(F.col("doc_id").isNull()), big).first()
    return low is not None and low >= 0 and high < 1 << (62 - PLACE_BITS) and not nulls and (longest or 0) < 1 << PLACE_BITS
