"""Vectorised tokens: the words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word's name is a 64-bit hash of its bytes, lane by lane, so all executors name a word alike without a dictionary; where
names decide, they are checked against the bytes (``same``) or taken with a second name. Texts are
taken in blocks of a quarter of a megabyte; a longer text is a block of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 18
_U = np.uint64


def byte_table(pattern: str) -> np.ndarray:
    """Which bytes belong to words: 'spaces' (all but ASCII white space) or 'alnum' (digits, a-z, bytes from 0x80)."""
    t = np.zeros(256, bool)
    if pattern == "spaces":
        t[:] = True
        t[[0x20, *range(0x09, 0x0E)]] = False
    else:
        t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


#: Bytes of a word up to which its names are made lane by lane for all words at once; longer words are hashed one by one.
LONG_WORD = 64
#: For each lane of eight bytes, the mask of its first k bytes.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def lanes(data: np.ndarray, start: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8k to 8k + 8 of words, as numbers; zeros stand for what is beyond a word. ``data`` has eight bytes to spare."""
    at = start + 8 * k
    wide = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    return wide[np.minimum(at, len(wide) - 1)].view("<u8").ravel() & _MASK[np.clip(size - 8 * k, 0, 8)]


class Words:
    """Words of a block of texts. ``start``/``end``: byte places; ``name``: hashes; ``first[i]:first[i + 1]``: the words
    of text i; ``doc``: the text of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool):
        self.data = _LOWER[data] if lower else data
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = is_word[self.data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(data)]
        begin[cuts] = inside[cuts]  # a text's first byte begins a word even where the text before ends in one
        self.start = np.flatnonzero(begin)
        stop = np.zeros(len(data) + 1, bool)
        stop[1:] = inside[:-1] & (begin[1:] | ~inside[1:])
        self.end = np.flatnonzero(stop)
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.padded = np.append(self.data, np.zeros(8, np.uint8))
        self.name = self._names(_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), 1)

    def _names(self, seed: np.uint64, factor: np.uint64, turn: int) -> np.ndarray:
        """Hash of each word: its lanes are mixed in one after the other, so that no order or pattern of bytes cancels out."""
        size = self.end - self.start
        out = mix(size.astype(np.uint64) * factor + seed)
        k, at = 0, np.flatnonzero(size <= LONG_WORD)
        while len(at):
            out[at] = mix((out[at] ^ lanes(self.padded, self.start[at], size[at], k)) * factor + seed)
            k += 1
            at = at[size[at] > 8 * k]
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]].tobytes(), seed=turn)
        return out

    def second_names(self) -> np.ndarray:
        """A second name of each word, independent of the first."""
        return self._names(_U(0xA0761D6478BD642F), _U(0x8EBC6AF09C88C6E3), 2)

    def same(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the words i[x] and j[x] are equal, by their bytes."""
        size = self.end - self.start
        equal = size[i] == size[j]
        k, at = 0, np.flatnonzero(equal & (size[i] <= LONG_WORD))
        while len(at):
            equal[at] = lanes(self.padded, self.start[i[at]], size[i[at]], k) == lanes(self.padded, self.start[j[at]], size[j[at]], k)
            k += 1
            at = at[equal[at] & (size[i[at]] > 8 * k)]
        for x in np.flatnonzero(equal & (size[i] > LONG_WORD)):
            equal[x] = self.text(i[x], i[x] + 1) == self.text(j[x], j[x] + 1)
        return equal

    def grams(self, n: int, names: np.ndarray | None = None) -> np.ndarray:
        """Hash of the n words from each word on; meaningful only where the text has them (see ``room``)."""
        names = self.name if names is None else names
        out = np.zeros(len(names), np.uint64)
        for k in range(n):
            m = max(len(out) - k, 0)
            out[:m] = out[:m] * _U(0xD6E8FEB86659FD93) + names[k:]
        return mix(out)

    def room(self) -> np.ndarray:
        """Number of words from each word to the end of its text."""
        return self.first[self.doc + 1] - np.arange(len(self.name))

    def text(self, a: int, b: int) -> list[bytes]:
        """The words a to b, as bytes."""
        return [self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b])]

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text, the two halves of a cryptographic digest of its words in order: equal only for equal words."""
        size = self.end - self.start
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[self.start] += 1
        edge[self.end] -= 1
        kept = self.data[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes()
        sizes = size.astype("<i8").tobytes()  # tell where the words end
        bound = np.concatenate([[0], np.cumsum(size)])[self.first].tolist()
        out = [hashlib.blake2b(kept[x:y] + sizes[8 * a : 8 * b], digest_size=16).digest()
               for x, y, a, b in zip(bound[:-1], bound[1:], self.first[:-1].tolist(), self.first[1:].tolist())]
        both = np.frombuffer(b"".join(out), "<i8").reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()


def blocks(texts: pa.Array, is_word: np.ndarray, lower: bool = False, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) of consecutive texts, about ``size`` bytes at a time. A null has no words."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    if texts.null_count:  # what lies under a null is not text
        texts = texts.fill_null("")
        yield from blocks(texts, is_word, lower, size)
        return
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        b = min(b, n)
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], is_word, lower)
        a = b
