"""Units: subword ids joined further, by what stands together in a corpus.

A public vocabulary may cut a corpus' own words in many short ids. ``learn_units`` joins, round by round, the pairs of
neighbours that are most frequent within its chunks (words or runs of signs); ``join`` does the same to any chunks. What
a chunk becomes depends on its own ids only.
"""

from __future__ import annotations

import numpy as np

_KEY = 1 << 20  # above any id


def _pairs(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Key of each id and the next one of its chunk, -1 for a chunk's last id."""
    keys = np.full(len(values), -1, np.int64)
    keys[:-1] = values[:-1] * _KEY + values[1:]
    ends = np.cumsum(counts)
    keys[ends[counts > 0] - 1] = -1
    return keys


def _joined(values: np.ndarray, counts: np.ndarray, keys: np.ndarray, table: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the (ascending) ``table`` become ``first`` and so on, from the left where they overlap."""
    place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    at = np.flatnonzero(table[place] == keys)
    if not len(at):
        return values, counts
    new_run = np.diff(at, prepend=-2) > 1
    run = np.flatnonzero(new_run)
    inside = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    at = at[inside % 2 == 0]
    values = values.copy()
    values[at] = first + place[at]
    owner = np.searchsorted(np.cumsum(counts), at, side="right")
    return np.delete(values, at + 1), counts - np.bincount(owner, minlength=len(counts))


def learn_units(values: np.ndarray, counts: np.ndarray, weight: np.ndarray, first: int, sizes: list[int], least: int = 2) -> list[tuple[int, np.ndarray]]:
    """A table of pairs to a round: at most ``sizes[k]`` of them, those found most often (``least`` times at least) in
    chunks that occur ``weight`` times each; chunk i has the next ``counts[i]`` of ``values``."""
    values, made = values.astype(np.int64), []
    for size in sizes:
        keys = _pairs(values, counts)
        real = keys >= 0
        found, number = np.unique(keys[real], return_inverse=True)
        if not len(found):
            break
        times = np.bincount(number, np.repeat(weight, counts)[real])
        best = np.argsort(-times, kind="stable")[:size]
        table = np.sort(found[best[times[best] >= least]])
        if not len(table):
            break
        made.append((first, table))
        values, counts = _joined(values, counts, keys, table, first)
        first += len(table)
    return made


def join(values: np.ndarray, counts: np.ndarray, units: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks with their pairs joined, as ``learn_units`` has found them."""
    values, counts = values.astype(np.int64), counts.astype(np.int64)
    for first, table in units:
        if len(values):
            values, counts = _joined(values, counts, _pairs(values, counts), table, first)
    return values, counts
