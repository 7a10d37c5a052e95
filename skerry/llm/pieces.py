"""Shared by the tokenising operators: gather variable-length entries of a flat table for a whole Arrow batch at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Memo:
    """Memory-bounded cache of a worker: words -> runs of ids in one flat array. It is emptied when it is full: of words, or of ids."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = 400_000, limit_ids: int = 1 << 23):
        self.encode, self.limit, self.limit_ids = encode, limit, limit_ids
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lens = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _store(self, words: list[str]) -> None:
        runs = self.encode(words)
        lens = np.fromiter(map(len, runs), np.int64, len(runs))
        flat = np.fromiter((i for r in runs for i in r), np.int32, int(lens.sum()))
        n = len(self.slot)
        while n + len(words) > len(self.starts):
            self.starts, self.lens = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lens))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.lens[n:n + len(words)] = lens
        self.starts[n:n + len(words)] = self.used + np.concatenate([[0], np.cumsum(lens)[:-1]]) if len(words) else 0
        self.flat[self.used:self.used + len(flat)] = flat
        self.used += len(flat)
        self.slot.update(zip(words, range(n, n + len(words))))

    def slots(self, words: list[str]) -> np.ndarray:
        """Places of distinct words, encoding those that are new."""
        if (len(self.slot) + len(words) > self.limit or self.used > self.limit_ids) and self.slot:
            self.clear()
        new = [w for w in words if w not in self.slot]
        if new:
            self._store(new)
        return np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenate flat[s:s+n] over all (s, n)."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lens), lens) + np.arange(total)]


def split_batch(texts: pa.Array, splitter: Callable) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text as (offsets of the texts, codes of the words, distinct words)."""
    lists = splitter(pc.fill_null(texts, ""))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    return offsets, np.asarray(coded.indices), coded.dictionary


def list_array(values: np.ndarray, lens: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32, copy=False)))
