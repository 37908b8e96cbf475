"""Mergeable Misra-Gries summaries of hashed items, as sorted arrays."""

from __future__ import annotations

import numpy as np


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first)


class Summary:
    """Counters of the items that may occur at least ``threshold`` times.

    Counts come as counted keys, in any number of parts. When there are more
    counters than the capacity, all are lowered by the first count beyond it and
    those at nothing go. ``lost`` is the sum of what all were lowered by, so an
    item's count lies between its counter and its counter plus ``lost``.

    The capacity stays above mass / ``slack``, with ``slack`` below the threshold, and
    where lowering would lose more than ``slack`` in all it doubles instead. So no item
    that reaches the threshold can go, whatever the order of the parts.
    """

    def __init__(self, threshold: int, slack: int, capacity: int = 1 << 16):
        if not 0 <= slack < threshold:
            raise ValueError("the loss must stay below the threshold")
        self.threshold, self.slack, self.capacity = threshold, slack, capacity
        self.keys = np.zeros(0, np.uint32)
        self.counts = np.zeros(0, np.int64)
        self.mass = self.lost = 0
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.mass += int(counts.sum())
        self._waiting.append((keys, counts))
        self._held += len(keys)
        if self._held > self.capacity // 2:
            self._fold()

    def merge(self, other: Summary) -> None:
        """Take in another summary; its loss adds to this one's."""
        other._fold()
        if self.lost + other.lost > self.slack:
            raise ValueError("the summaries together have lost more than the slack")
        mass = self.mass + other.mass
        self.lost += other.lost
        self.add(other.keys, other.counts)
        self.mass = mass

    def _fold(self) -> None:
        keys, counts = zip((self.keys, self.counts), *self._waiting)
        self._waiting, self._held = [], 0
        self.keys, self.counts = summed(
            np.concatenate(keys), np.concatenate(counts).astype(np.int64, copy=False)
        )
        if self.slack:
            self.capacity = max(self.capacity, self.mass // self.slack + 1)
        while (over := len(self.counts) - self.capacity) > 0:
            # The largest count that has no counter left.
            lower = int(np.partition(self.counts, over - 1)[over - 1])
            if self.lost + lower > self.slack:
                self.capacity *= 2
                continue
            self.lost += lower
            stay = self.counts > lower
            self.keys, self.counts = self.keys[stay], self.counts[stay] - lower

    def survivors(self) -> np.ndarray:
        """Keys that may reach the threshold: every one that does, and few others."""
        self._fold()
        return self.keys[self.counts + self.lost >= self.threshold]
