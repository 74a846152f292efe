"""Spelling variants: words one edit apart, and for each the far more frequent one that it is a variant of.

A word and its neighbour share what stands in front of the edit and what stands behind it. Words are sorted from both ends
and cut into chunks; a wavelet matrix between the two orders reports, for each edit position, the words with that
beginning and that end. An edit in a word's second half leaves its first half, so only chunks with that beginning are asked;
one in the first half is asked of the words read backwards.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, prepare
from .wavelet import WordLists

RUN, BREAK = re.compile("[A-Za-zÀ-ÿ]+"), re.compile("[^A-Za-zÀ-ÿ]")
#: Above all letters of a run, to end the interval of a beginning.
ABOVE = "Ā"
#: Characters of a text that are looked at together, words that a task counts before it hands them on, words of a chunk (about;
#: larger beyond MAX_CHUNKS), and words and letters that are asked together.
PIECE, MAX_COUNTED, CHUNK_WORDS, MAX_CHUNKS, ASKED, ASKED_LETTERS = 1 << 20, 200_000, 50_000, 20_000, 20_000, 4 << 20
#: Rounds of pointer jumping that any chain ends within, as counts double along it.
MAX_ROUNDS = 8


def misspelt(run: str, seed: int, every: int = 97) -> str:
    """The run without one letter, if its checksum, continued from ``seed``, is a multiple of ``every``."""
    h = zlib.crc32(run.encode(), seed)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def runs_of(text: bytes) -> Counter:
    """Runs of letters, capitals A to Z made small; a piece of the text after the other."""
    lowered = text.lower().decode("utf-8", "replace")  # bytes: only A to Z change
    counts: Counter = Counter()
    at = 0
    while at < len(lowered):
        end = at + PIECE
        cut = BREAK.search(lowered, end) if end < len(lowered) else None
        end = cut.start() if cut else len(lowered)
        counts.update(RUN.findall(lowered, at, end))
        at = end
    return counts


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """``word, n``: words of at least ``min_chars`` letters that occur at least ``min_count`` times in all texts, after the
    letters that ``misspelt`` takes away. Tasks count before words are dealt."""
    prepare(docs.sparkSession)

    def batch_of(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if not text:
                    continue
                seed = zlib.crc32(f"{'' if name is None else name}:".encode())
                for r, k in runs_of(text).items():
                    word = misspelt(r, seed)
                    if len(word) >= min_chars:
                        counts[word] = counts.get(word, 0) + k
                if len(counts) >= MAX_COUNTED:
                    yield batch_of(counts)
                    counts = {}
        if counts:
            yield batch_of(counts)

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("name"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class Chunk:
    """Some of the words, as they stand in a list sorted by ``keys`` (the words themselves, or read backwards)."""

    def __init__(self, keys: list[str], counts: list[int], backward: bool):
        self.words = [k[::-1] for k in keys] if backward else keys
        self.counts, self.backward = np.array(counts, np.int64), backward
        self.rank = np.empty(len(keys), np.int64)
        self.rank[sorted(range(len(keys)), key=self.words.__getitem__)] = np.arange(len(keys))
        sizes = np.fromiter(map(len, keys), np.int64, len(keys))
        self.own = {int(s): np.flatnonzero(sizes == s) for s in np.unique(sizes)}
        self.keys, self.lists = keys, {}

    def lists_of(self, size: int) -> WordLists | None:
        if size not in self.lists:
            own = self.own.get(size)
            self.lists[size] = None if own is None else WordLists(_letters([self.keys[i] for i in own], size))
        return self.lists[size]

    def ask(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``keys`` and in the chunk of all pairs one edit apart that this reading finds: of an edit that could be at
        several positions, the last one counts."""
        sizes = np.fromiter(map(len, keys), np.int64, len(keys))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes).tolist():
            asked = np.flatnonzero(sizes == size)
            words = _letters([keys[i] for i in asked], size)
            half = size - size // 2 if self.backward else size // 2
            for other in (size, size + 1, size - 1):
                lists = self.lists_of(other)
                if lists is None:
                    continue
                w, i, x = lists.neighbours(words, half + (self.backward and other > size))
                there = lists.letters[x, np.minimum(i, other - 1)]
                here, before = words[w, np.minimum(i, size - 1)], words[w, np.maximum(i - 1, 0)]
                if other == size:
                    good = there != here
                elif other > size:
                    good = (i == 0) | (there != before) if self.backward else (i == size) | (there != here)
                else:
                    good = (i == 0) | (here != before) if self.backward else (i == size - 1) | (words[w, np.minimum(i + 1, size - 1)] != here)
                found.append((asked[w[good]], self.own[other][x[good]]))
        return tuple(np.concatenate(a) for a in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _letters(words: list[str], size: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), size)


def chunk_bounds(words: DataFrame, key: str, n: int) -> list[str]:
    """First keys of all chunks but the first; a row a chunk comes to the driver."""
    if n == 1:
        return []
    cut = words.select(key).repartitionByRange(n, key)
    return sorted(r["first"] for r in cut.groupBy(F.spark_partition_id().alias("chunk")).agg(F.min(key).alias("first")).collect())[1:]


def near_words(words: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """``word, n_near, best, best_n`` of ``word, n`` (distinct words of letters up to U+00FF): how many words differ from it by one
    letter put in, taken out or replaced, and the most frequent of them, the first in order among equals. Words without have no row."""
    both = words.select("word", "n", F.reverse("word").alias("turned"))
    n = min(MAX_CHUNKS, max(1, -(-words.count() // chunk_words)))
    bounds = (chunk_bounds(both, "word", n), chunk_bounds(both, "turned", n))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for word, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                half = len(word) // 2
                for way, key, kept in ((0, word, half), (1, word[::-1], len(word) - half)):
                    out.append((way, bisect_right(bounds[way], key), 0, key, count))
                    start = key[:kept]
                    out.extend((way, c, 1, key, count) for c in range(bisect_right(bounds[way], start), bisect_left(bounds[way], start + ABOVE) + 1))
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()))], names=["way", "chunk", "kind", "key", "n"])

    def answer(chunk: Chunk, asked: list[str]) -> pa.RecordBatch:
        w, x = chunk.ask(asked)
        sort = np.lexsort((chunk.rank[x], -chunk.counts[x], w))
        w, x = w[sort], x[sort]
        first = np.flatnonzero(np.diff(w, prepend=-1))
        near = np.diff(np.append(first, len(w)))
        words = [asked[i][::-1] if chunk.backward else asked[i] for i in w[first]]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(near.astype(np.int64)), pa.array([chunk.words[i] for i in x[first]], pa.string()), pa.array(chunk.counts[x[first]])],
                                          names=["word", "n_near", "best", "best_n"])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts, chunk, asked, letters = None, [], [], None, [], 0
        for batch in batches:
            for way, c, kind, key, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (way, c) != now:
                    if asked:
                        yield answer(chunk, asked)
                    now, keys, counts, chunk, asked, letters = (way, c), [], [], None, [], 0
                if kind == 0:
                    keys.append(key)
                    counts.append(n)
                    continue
                if chunk is None:
                    chunk = Chunk(keys, counts, way == 1)
                asked.append(key)
                letters += len(key)
                if len(asked) >= ASKED or letters >= ASKED_LETTERS:
                    yield answer(chunk, asked)
                    asked, letters = [], 0
        if asked:
            yield answer(chunk, asked)

    prepare(words.sparkSession)
    dealt = words.select("word", "n").mapInArrow(deal, "way int, chunk int, kind int, key string, n long")
    dealt = dealt.repartition("way", "chunk").sortWithinPartitions("way", "chunk", "kind", "key")
    found = dealt.mapInArrow(report, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.less")).alias("best_n"))


def follow(links: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: where the forms lead in the end. Every round doubles what a link spans."""
    now = Table(links.select("word", F.col("form").alias("root")), "forms")
    for _ in range(MAX_ROUNDS):
        further = now.df.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = now.df.join(further, "root", "left")
        after = Table(joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        moved = after.df.filter("moved").limit(1).count()
        now.drop()
        now = Table(after.df.select("word", "root"), "forms") if moved else after
        if not moved:
            return now.df.select("word", "root")
        after.drop()
    raise RuntimeError("forms lead in a circle")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words that ``count_words`` finds: the form is the most frequent word one edit away
    if it is at least ``ratio`` times as frequent, else null; the root is where forms lead, the word itself without one.

    Null and empty texts have no words; a null id is written as nothing; repeated rows count as often as they are there; of
    equally frequent neighbours the first in code-point order is taken. Very long texts are read whole, in pieces, and a word
    may be of any length; an empty table gives no rows; other columns are not read, whatever their names.
    """
    words = Table(count_words(docs, id_col, text_col), "words").df
    near = near_words(words).withColumnRenamed("word", "_word")
    out = words.join(near, F.col("word") == F.col("_word"), "left").withColumn("_is", F.col("best_n") >= ratio * F.col("n"))
    forms = Table(out.select("word", F.when(F.col("_is"), F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                             F.when(F.col("_is"), F.col("best_n")).alias("form_n")), "variants").df
    roots = follow(forms.filter("form is not null")).withColumnRenamed("word", "_word")
    return forms.join(roots, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
