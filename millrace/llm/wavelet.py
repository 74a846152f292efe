"""Two-dimensional range reporting: words of one length, sorted from both ends, with a wavelet matrix between the orders."""

from __future__ import annotations

import numpy as np

#: Bytes of the prefixes and suffixes that are searched together.
BLOCK_BYTES = 8 << 20


class WaveletMatrix:
    """A permutation of 0 to n - 1, a level for each bit: ``report`` finds the values of a range that lie in an interval."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.before: list[np.ndarray] = []
        for b in reversed(range(self.bits)):
            bit = (values >> b) & 1
            self.before.append(np.concatenate([[0], np.cumsum(1 - bit)]).astype(np.int32))  # zeros in front of each place
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and values: of each query, all values in its places ``[left, right)`` that are in ``[low, high)``."""
        query = np.flatnonzero((left < right) & (low < high))
        l, r, value = left[query], right[query], np.zeros(len(query), np.int64)
        for zeros, b in zip(self.before, reversed(range(self.bits))):
            l0, r0 = zeros[l].astype(np.int64), zeros[r].astype(np.int64)
            one = value + (1 << b)
            down, up = (l0 < r0) & (low[query] < one), (l - l0 < r - r0) & (one < high[query])
            down &= value < high[query]
            up &= low[query] < one + (1 << b)
            total = int(zeros[-1])
            l, r, value, query = (np.concatenate([x[down], y[up]]) for x, y in ((l0, total + l - l0), (r0, total + r - r0), (value, one), (query, query)))
        return query, value


def _words(letters: np.ndarray) -> np.ndarray:
    """A matrix of letters as strings of its width."""
    return np.ascontiguousarray(letters).view(f"S{letters.shape[1]}").ravel()


def _fit(letters: np.ndarray, width: int) -> np.ndarray:
    """A matrix of letters cut, or filled with nothing, to a width."""
    if letters.shape[1] >= width:
        return letters[:, :width]
    return np.pad(letters, ((0, 0), (0, width - letters.shape[1])))


class WordLists:
    """Words of one length, a row of letters (one byte, not 0) each, in order, and the same in the order of their ends."""

    def __init__(self, letters: np.ndarray):
        self.letters, self.width = letters, letters.shape[1]
        back = letters[:, ::-1]
        self.order = np.argsort(_words(back), kind="stable")
        self.forward, self.backward = _words(letters), _words(back[self.order])
        self.back = np.ascontiguousarray(back[self.order])
        rank = np.empty(len(letters), np.int64)
        rank[self.order] = np.arange(len(letters))
        self.matrix = WaveletMatrix(rank)

    @staticmethod
    def _shared(query: np.ndarray, at: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """The longest beginning that a query shares with any word: with one of the two that it would stand between."""
        most = np.zeros(len(query), np.int64)
        c = min(query.shape[1], lists.shape[1])
        for place in (at - 1, at):
            there = (place >= 0) & (place < len(lists))
            same = query[there, :c] == lists[place[there], :c]
            most[there] = np.maximum(most[there], np.where(same.all(1), c, same.argmin(1)))
        return most

    def neighbours(self, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words (rows of ``words``, one length), places and words of these lists: for each edit position from ``least`` on, what
        has the word's letters in front of the position as its beginning and those behind it as its end."""
        n, size = words.shape
        total, most = (size, size) if self.width > size else (size - 1, size - 1)
        query, back = _fit(words, self.width), _fit(words[:, ::-1], self.width)
        front = self._shared(words, np.searchsorted(self.forward, _words(query)), self.letters)
        end = self._shared(words[:, ::-1], np.searchsorted(self.backward, _words(back)), self.back)
        first, last = np.maximum(least, total - end), np.minimum(front, most)
        counts = np.maximum(last - first + 1, 0)
        which = np.repeat(np.arange(n), counts)
        place = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step, column = max(1, BLOCK_BYTES // self.width), np.arange(self.width)
        for a in range(0, len(which), step):
            w, i = which[a : a + step], place[a : a + step]
            ranges = []
            for letters, size_, ordered in ((query[w], i, self.forward), (back[w], total - i, self.backward)):
                inside = column < size_[:, None]
                ranges.append(np.searchsorted(ordered, _words(np.where(inside, letters, 0).astype(np.uint8)), "left"))
                ranges.append(np.searchsorted(ordered, _words(np.where(inside, letters, 255).astype(np.uint8)), "right"))
            q, value = self.matrix.report(*ranges)
            found.append((w[q], i[q], self.order[value]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
