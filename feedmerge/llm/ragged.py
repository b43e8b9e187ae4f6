"""A bounded cache of rows of integers by 64-bit hash, looked up in bulk.

Each worker meets the same words again and again; this keeps what was computed
for one (token ids, links) in flat arrays, so a batch costs a few array
operations and no Python object a word.  When it is full, the half that was used
least recently goes.
"""

from __future__ import annotations

import numpy as np


def spread(offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places offsets[k], offsets[k] + 1, ... (sizes[k] of them), for each k."""
    ends = np.cumsum(sizes)
    return np.repeat(offsets - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Column:
    def __init__(self, kind: str):
        self.flat, self.offset, self.size = np.zeros(1024, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(flat)] = flat
        self.offset = np.concatenate([self.offset, self.used + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.used += len(flat)

    def rows(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.size[slots]
        return self.flat[spread(self.offset[slots], sizes)], sizes


class RaggedCache:
    def __init__(self, limit: int, *kinds: str):
        self.limit, self.kinds, self.clock = limit, kinds, 0
        self._reset()

    def _reset(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.stamp = np.zeros(0, np.int64)
        self.columns = [_Column(k) for k in self.kinds]

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of sorted keys; -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        slots = np.where(self.keys[at] == keys, self.slots[at], -1)
        self.clock += 1
        self.stamp[slots[slots >= 0]] = self.clock
        return slots

    def add(self, keys: np.ndarray, *rows: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """New rows, a (flat, sizes) pair for each column; their slots."""
        slots = len(self.stamp) + np.arange(len(keys))
        both, place = np.concatenate([self.keys, keys]), np.concatenate([self.slots, slots])
        order = np.argsort(both, kind="stable")
        self.keys, self.slots = both[order], place[order]
        self.stamp = np.concatenate([self.stamp, np.full(len(keys), self.clock)])
        for column, (flat, sizes) in zip(self.columns, rows):
            column.add(flat, sizes)
        return slots

    def shrink(self) -> np.ndarray | None:
        """If the cache is full, keep the half used last: the old slots kept,
        which are then slots 0, 1, 2 and so on."""
        if len(self.keys) <= self.limit:
            return None
        kept = np.sort(np.argsort(self.stamp, kind="stable")[len(self.stamp) // 2:])
        number = np.full(len(self.stamp), -1)
        number[kept] = np.arange(len(kept))
        live = number[self.slots] >= 0
        keys, slots, stamp, old = self.keys[live], number[self.slots[live]], self.stamp[kept], self.columns
        self._reset()
        self.keys, self.slots, self.stamp = keys, slots, stamp
        for column, before in zip(self.columns, old):
            column.add(*before.rows(kept))
        return kept

    def rows(self, column: int, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat, sizes): the rows of a column at the slots, one after another."""
        return self.columns[column].rows(slots)
