"""Benchmark decontamination by winnowing.

Both sides keep the smallest k-gram hash of every w consecutive k-grams. Any shared span of at least k + w - 1 words
holds a k-gram that both sides keep, so joining the kept fingerprints misses none; each hit is then extended: the
windows around it are looked up among the benchmark's, checked against the words themselves, and joined to runs. A
benchmark of a checked size goes to every task, and the documents are never shuffled. For a larger one, both sides' fingerprints
are joined by Spark, then the words of the windows around those that met; the documents are written once, and only those with
such fingerprints are read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, prepare
from .textkit import Words, blocks, byte_table, mix

#: Words of a benchmark that is sent to the tasks (about 50 bytes each there). The fingerprints of a larger one are joined.
MAX_BLOCK_WORDS = 2_000_000
_BITS = 20
#: Where they are joined, document fingerprints that can't meet any are told by a map of 2**MAP_BITS bits (8 MB).
MAP_BITS = 26
#: A key is hot if it has so many rows, and more than one in HOT_SHARE of all; so there are no more than HOT_SHARE hot ones.
HOT_ROWS, HOT_SHARE = 100_000, 10_000
#: Parts that the rows of a hot key are dealt into where they meet the items with it.
SALTS = 64
#: Words as the tasks take them, for counts in the JVM.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Part:
    """What an index holds for windows of one length: kept fingerprints, and the windows by name, each with its items."""

    def __init__(self, prints: np.ndarray, names: np.ndarray, items: np.ndarray, places: np.ndarray):
        self.prints = np.unique(prints)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.prints >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        order = np.lexsort((places, items, names))
        self.names, self.items, self.places = names[order], items[order], places[order]
        self.unique, self.first = np.unique(self.names, return_index=True)
        self.first = np.append(self.first, len(self.names))


class Index:
    """Windows of a block of benchmark items, by length: the full one and those of shorter items."""

    def __init__(self, items: pa.Table, window: int, k: int):
        self.window, self.k = window, k
        self.ids = items.column(0).to_pylist()
        self.words: list[list[bytes]] = []
        found: dict[int, list] = {}
        at = 0
        for _, _, w in blocks(items.column(1).combine_chunks(), byte_table("alnum"), lower=True):
            self.words += [w.text(a, b) for a, b in zip(w.first[:-1], w.first[1:])]
            room = w.room()
            sizes = np.diff(w.first)
            for length in {window, *(int(s) for s in np.unique(sizes) if 0 < s < window)}:
                gram, span = shape(length, self.k)
                ok = (sizes >= window if length == window else sizes == length)[w.doc]
                kept, h = fingerprints(w, gram, span, room)
                starts = np.flatnonzero(ok & (room >= length))
                found.setdefault(length, []).append((h[ok[kept]], w.grams(length)[starts], w.doc[starts] + at, starts - w.first[w.doc[starts]]))
            at += len(w.first) - 1
        self.parts = {length: Part(*(np.concatenate(c) for c in zip(*xs))) for length, xs in found.items() if sum(len(x[0]) for x in xs)}

    def hits(self, w: Words) -> tuple[list[set], list[list]]:
        """For each text of the block: item numbers found, and (from, to) word ranges hit, one for each run of windows.

        A text's kept fingerprints that the benchmark has too are extended at once: all windows around them are looked up
        by name, so that it makes no difference how many items share the fingerprint; and the words decide."""
        items: list[set] = [set() for _ in range(len(w.first) - 1)]
        spans: list[list] = [[] for _ in items]
        room = w.room()
        for length, part in self.parts.items():
            gram, span = shape(length, self.k)
            kept, g = fingerprints(w, gram, span, room)
            use = part.seen[(g >> np.uint64(64 - _BITS)).astype(np.int64)]
            kept, g = kept[use], g[use]
            kept = kept[_place(part.prints, g) >= 0]
            if not len(kept):
                continue
            starts = starts_around(w, kept, length, gram, room)
            where = _place(part.unique, w.grams(length)[starts])
            for s, x in zip(starts[where >= 0].tolist(), where[where >= 0].tolist()):
                d, words = int(w.doc[s]), w.text(s, s + length)
                a, b = part.first[x], part.first[x + 1]
                same = [i for i, q in self._windows(part, a, b) if self.words[i][q : q + length] == words]
                if same:
                    items[d].update(same)
                    s -= int(w.first[d])
                    if spans[d] and spans[d][-1][0] <= s <= spans[d][-1][1]:
                        spans[d][-1] = (spans[d][-1][0], max(spans[d][-1][1], s + length))
                    else:
                        spans[d].append((s, s + length))
        return items, spans

    @staticmethod
    def _windows(part: Part, a: int, b: int) -> list[tuple[int, int]]:
        """(item, place) of the windows a to b: one for each item."""
        return list(dict(zip(part.items[a:b].tolist(), part.places[a:b].tolist())).items())


def shape(length: int, k: int) -> tuple[int, int]:
    """(k, w) with k + w - 1 = length; short windows are taken whole."""
    return (k, length - k + 1) if length >= 2 * k - 1 else (length, 1)


def starts_around(w: Words, kept: np.ndarray, length: int, gram: int, room: np.ndarray) -> np.ndarray:
    """Where windows of ``length`` words that hold one of the kept grams start."""
    around = np.zeros(len(room) + 1, np.int32)
    np.add.at(around, np.maximum(kept - (length - gram), w.first[w.doc[kept]]), 1)
    np.add.at(around, kept + 1, -1)
    return np.flatnonzero((np.cumsum(around[:-1]) > 0) & (room >= length))


def _place(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where values stand in an ordered array without repeats; -1 where they don't."""
    if not len(ordered):
        return np.full(len(values), -1)
    i = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.where(ordered[i] == values, i, -1)


def fingerprints(w, k: int, span: int, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that are smallest in some ``span`` consecutive ones. Ties keep all."""
    g = w.grams(k)
    n = len(g)
    g = np.where(room >= k, g, np.uint64(0xFFFFFFFFFFFFFFFF))
    if span == 1:
        kept = np.flatnonzero(room >= k)
        return kept, g[kept]
    low = g.copy()  # smallest of the span from each place on; places without room there start no span
    for s in range(1, span):
        low[: n - s] = np.minimum(low[: n - s], g[s:]) if s < n else low[: n - s]
    full = room >= k + span - 1
    keep = np.zeros(n, bool)
    for s in range(span):
        m = n - s
        if m > 0:
            keep[s:] |= full[:m] & (g[s:] == low[:m])
    kept = np.flatnonzero(keep)
    return kept, g[kept]


def _merge(spans: list[tuple[int, int]]) -> int:
    """Number of words covered."""
    return sum(b - a for a, b in _runs(spans))


def _runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges joined where they meet."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def sent_whole(work: DataFrame, bench: DataFrame, kind: str, window: int, k: int) -> DataFrame:
    """``work`` with ``n_words, items, spans`` for ``text``: every task has the whole benchmark, which is of a checked size."""
    sent = work.sparkSession.sparkContext.broadcast(Index(bench.toArrow(), window, k))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = sent.value
        is_word = byte_table("alnum")
        for batch in batches:
            n_words: list[int] = []
            items: list[list] = [[] for _ in range(batch.num_rows)]
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            for a, b, w in blocks(batch.column(batch.schema.get_field_index("text")), is_word, lower=True):
                n_words += np.diff(w.first).tolist()
                for i, found, where in zip(range(a, b), *index.hits(w)):
                    items[i] = [index.ids[x] for x in found]
                    spans[i] = [{"a": x, "b": y} for x, y in where]
            new = {"n_words": pa.array(n_words, pa.int64())} | {
                c: pa.array(v, batch.schema.field(c).type) for c, v in (("items", items), ("spans", spans))}
            yield pa.RecordBatch.from_arrays([new.get(f.name, batch.column(j)) for j, f in enumerate(batch.schema)], schema=batch.schema)

    work = work.withColumns({"n_words": F.lit(0).cast("long"), "items": F.array().cast(f"array<{kind}>"), "spans": F.array().cast("array<struct<a:int,b:int>>")})
    return work.mapInArrow(search, work.schema).drop("text")


def _prints(w: Words, length: int, k: int, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of kept k-grams for windows of ``length``, and their fingerprints, which tell the lengths apart."""
    kept, g = fingerprints(w, *shape(length, k), room)
    return kept, mix(g + np.uint64(length))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) if isinstance(v, np.ndarray) else v for v in columns.values()], names=list(columns))


def _known(rows: DataFrame, others: DataFrame, on: list[str]) -> Table:
    """The keys ``on`` of ``rows`` that ``others`` have too, and whether they are ``hot``. Both sides are counted before
    they are dealt by key."""
    both = Table(rows.groupBy(*on).agg(F.count("*").alias("n")).join(others.select(*on).distinct(), on, "left_semi"), "known-keys")
    least = max(HOT_ROWS, (both.df.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    out = Table(both.df.select(*on, (F.col("n") > least).alias("hot")), "known-keys")
    both.drop()
    return out


def _having(rows: DataFrame, known: Table, on: list[str]) -> DataFrame:
    """``rows`` with a known key, and ``hot``. Rows with hot keys, of which there are few, stay where they are."""
    hot = F.broadcast(known.df.filter("hot"))
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(known.df.filter("not hot"), on))


def joined(work: DataFrame, bench: DataFrame, kind: str, window: int, k: int) -> DataFrame:
    """What ``sent_whole`` gives, for a benchmark of any size: nothing of it is sent but a map of fingerprints of 8 MB."""
    spark = work.sparkSession
    is_word = byte_table("alnum")
    count = lambda t: F.coalesce(F.regexp_count(t, F.lit(_WORD)), F.lit(0)).cast("long")
    lengths = sorted(r[0] for r in bench.select(F.least(count("text"), F.lit(window))).distinct().collect() if r[0])  # at most ``window``

    def of_items(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        """Fingerprints of items, or else ``item, length, words`` for each of their windows."""
        for batch in batches:
            for a, _, w in blocks(batch.column(1), is_word, lower=True):
                room, size = w.room(), np.minimum(np.diff(w.first), window)[w.doc]
                for length in np.unique(size).tolist():
                    if whole:
                        starts = np.flatnonzero((size == length) & (room >= length))
                        yield _batch(item=batch.column(0).take(pa.array(w.doc[starts] + a)), length=np.full(len(starts), length, np.int32),
                                     words=pa.array([b" ".join(w.text(s, s + length)) for s in starts.tolist()], pa.binary()))
                    else:
                        kept, h = _prints(w, length, k, room)
                        yield _batch(print=h[size[kept] == length].view(np.int64))

    prints = Table(bench.mapInArrow(lambda x: of_items(x, False), "print long").distinct(), "item-prints")
    windows = Table(bench.mapInArrow(lambda x: of_items(x, True), f"item {kind}, length int, words binary").distinct(), "item-windows")
    # One bit for each fingerprint's beginning, 64 in a row.
    cells = prints.df.groupBy(F.shiftrightunsigned("print", 70 - MAP_BITS).alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(print, {64 - MAP_BITS}) & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << MAP_BITS - 6, np.uint64)
    bits[cells.column(0).to_numpy()] = cells.column(1).to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast(bits)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``row, length, place, print`` of document fingerprints that the map has."""
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for a, _, w in blocks(batch.column(1), is_word, lower=True):
                room = w.room()
                for length in lengths:
                    kept, h = _prints(w, length, k, room)
                    at = h >> np.uint64(64 - MAP_BITS)
                    use = (sent.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
                    kept, h = kept[use], h[use]
                    yield _batch(row=rows[w.doc[kept] + a], length=np.full(len(kept), length, np.int32), place=(kept - w.first[w.doc[kept]]).astype(np.int32), print=h.view(np.int64))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``row, length, a, words`` of the windows around ``places``."""
        for batch in batches:
            rows, places = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for a, b, w in blocks(batch.column(1), is_word, lower=True):
                room = w.room()
                for length in lengths:
                    kept = np.array([w.first[i - a] + x["place"] for i in range(a, b) for x in places[i] if x["length"] == length], np.int64)
                    starts = starts_around(w, kept, length, shape(length, k)[0], room)
                    yield _batch(row=rows[w.doc[starts] + a], length=np.full(len(starts), length, np.int32), a=(starts - w.first[w.doc[starts]]).astype(np.int32),
                                 words=pa.array([b" ".join(w.text(s, s + length)) for s in starts.tolist()], pa.binary()))

    def to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [[{"a": x, "b": y} for x, y in _runs([(s["a"], s["b"]) for s in spans])] for spans in batch.column(1).to_pylist()]
            yield _batch(row=batch.column(0), spans=pa.array(runs, batch.schema.field(1).type))

    # Rows are numbered once, in a table: numbers of a scan change with how it is cut.
    numbered = Table(work.withColumn("row", F.monotonically_increasing_id()), "numbered-documents")
    found = Table(numbered.df.select("row", "text").mapInArrow(suspects, "row long, length int, place int, print long"), "suspects")
    met = _known(found.df, prints.df, ["print"])
    places = _having(found.df, met, ["print"]).groupBy("row").agg(F.collect_list(F.struct("length", "place")).alias("places"))
    again = numbered.df.select("row", "text").join(places, "row").select("row", "text", "places")
    near = Table(again.mapInArrow(around, "row long, length int, a int, words binary"), "windows-around")
    same = _known(near.df, windows.df, ["length", "words"])
    hits = Table(_having(near.df, same, ["length", "words"]), "window-hits")
    spans = hits.df.groupBy("row").agg(F.collect_list(F.struct("a", (F.col("a") + F.col("length")).alias("b"))).alias("spans"))
    spans = spans.mapInArrow(to_runs, "row long, spans array<struct<a:int,b:int>>")
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).otherwise(0)
    owners = windows.df.join(same.df, ["length", "words"]).select("item", "length", "words", F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), SALTS - 1).otherwise(0))).alias("part"))
    items = hits.df.select("row", "length", "words", part.alias("part")).distinct().join(owners, ["length", "words", "part"])
    items = items.select("row", "item").distinct().groupBy("row").agg(F.collect_list("item").alias("items"))
    result = Table(spans.join(items, "row"), "contaminated-rows")
    for t in (prints, windows, found, met, near, same, hits):
        t.drop()
    empty = lambda c: F.coalesce(c, F.array().cast(result.df.schema[c].dataType)).alias(c)
    out = numbered.df.withColumn("n_words", count("text")).drop("text").join(result.df, "row", "left")
    return out.select(*[c for c in work.columns if c != "text"], "n_words", empty("items"), empty("spans"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                       carry: tuple[str, ...] = (), max_block_words: int = MAX_BLOCK_WORDS) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans`` and ``carry``.

    Words: runs of digits, ASCII letters (lower-cased) and non-ASCII characters. A document word is hit if it lies in an
    occurrence of ``window`` consecutive words of an item, or of a whole shorter item that has words. ``items``: the ids
    with occurrences, sorted as strings; ``spans``: the hit word ranges. Null or empty texts have no words and no
    hits; an item without words matches nothing; repeated item ids count once; null item ids are left out. An empty
    benchmark contaminates nothing. Repeated documents are rows of their own. Other columns are ignored.
    """
    if not 1 <= k <= window:
        raise ValueError("k must lie between 1 and the window")
    spark = docs.sparkSession
    prepare(spark)
    bench = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text}`").alias("text")).filter("item is not null and text is not null")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    kind = benchmark.schema[item_col].dataType.simpleString()
    kept = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carry")] if carry else []
    work = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *kept)
    work = (sent_whole if size <= 6 * max_block_words else joined)(work, bench, kind, window, k)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
            hit = [_merge([(s["a"], s["b"]) for s in x]) if x else 0 for x in spans]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit, pa.int64())], schema=batch.schema.append(pa.field("n_hit", pa.int64())))

    work = work.mapInArrow(total, work.withColumn("n_hit", F.lit(0).cast("long")).schema)
    ids = F.sort_array(F.transform(F.array_distinct("items"), lambda x: x.cast("string")))
    return work.select(
        "doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), ids.alias("items"), "spans", *[F.col(f"carry.`{c}`") for c in carry])

