"""A table of byte strings already seen and what was made of them, looked up for a whole buffer at once.

Strings are found by a 64-bit hash of their bytes and compared with the bytes kept in the table, so a hash that
stands for another string than before is made anew. The table is emptied when it passes its limit, which counts its
bytes: memory is bounded, and results don't depend on it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from strandwork.llm._common import RangeHash, flat_index

LIMIT_BYTES = 32 << 20
_ROW = 40  # bytes to an entry besides its string and values


class SpanTable:
    """``learn`` takes distinct byte strings and gives all their values in one array, and how many each has."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype, limit: int = LIMIT_BYTES):
        self.learn, self.dtype, self.limit = learn, dtype, limit
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.word_at = self.word_len = self.at = self.len = np.zeros(0, np.int64)
        self.words, self.values = np.zeros(0, np.uint8), np.zeros(0, self.dtype)

    @property
    def bytes(self) -> int:
        return _ROW * len(self.hashes) + self.words.nbytes + self.values.nbytes

    def _add(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """``hashes`` are ascending and none of them is in the table."""
        made, lengths = self.learn(words)
        word_lengths = np.fromiter(map(len, words), np.int64, len(words))
        place = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, place, hashes)
        self.at = np.insert(self.at, place, len(self.values) + np.cumsum(lengths) - lengths)
        self.len = np.insert(self.len, place, lengths)
        self.word_at = np.insert(self.word_at, place, len(self.words) + np.cumsum(word_lengths) - word_lengths)
        self.word_len = np.insert(self.word_len, place, word_lengths)
        self.values = np.concatenate([self.values, made.astype(self.dtype, copy=False)])
        self.words = np.concatenate([self.words, np.frombuffer(b"".join(words), np.uint8)])

    def _find(self, hashes):
        """Place of each hash in the table, -1 if it isn't there."""
        place = np.searchsorted(self.hashes, hashes)
        place[place == len(self.hashes)] = 0
        return np.where(self.hashes[place] == hashes, place, -1) if len(self.hashes) else np.full(len(hashes), -1)

    def lookup(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of all strings ``buf[starts[i]:ends[i]]`` one after another, and how many each has."""
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        if self.bytes > self.limit:
            self.clear()
        hashes, first, inverse = np.unique(RangeHash(buf)(starts, ends), return_index=True, return_inverse=True)
        a, b = starts[first], ends[first]
        place = self._find(hashes)
        known = np.flatnonzero(place >= 0)
        same = self.word_len[place[known]] == (b - a)[known]
        clash = not same.all()
        if not clash:
            length = (b - a)[known]
            clash = (buf[flat_index(a[known], length)] != self.words[flat_index(self.word_at[place[known]], length)]).any()
        if clash:
            self.clear()
            place = np.full(len(hashes), -1)
        # of the buffer's own strings with one hash, all must be one string
        like = first[inverse]
        length = ends - starts
        if (length != length[like]).any() or (buf[flat_index(starts, length)] != buf[flat_index(starts[like], length)]).any():
            raw = buf.tobytes()
            values, counts = self.learn([raw[x:y] for x, y in zip(starts.tolist(), ends.tolist())])
            return values.astype(self.dtype, copy=False), counts
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            raw = buf.tobytes()
            self._add(hashes[fresh], [raw[x:y] for x, y in zip(a[fresh].tolist(), b[fresh].tolist())])
            place = self._find(hashes)
        at, length = self.at[place][inverse], self.len[place][inverse]
        return self.values[flat_index(at, length)], length
