"""A bounded table of text pieces over arrays: two 64-bit keys of a piece to numbers about it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .blocks import span_keys

PORTION = 1 << 18


class PieceTable:
    """Open addressing over ``1 << bits`` slots; a full table (half of its slots hold a piece) starts anew.

    A piece is told by two independent 64-bit keys: one that finds its slot and one that is compared
    there. ``columns`` hold a 32-bit number a piece each, such as where its ids lie in a store and how
    many they are. Pieces of more than ``LONGEST`` bytes aren't kept.
    """

    LONGEST = 64

    def __init__(self, bits: int, columns: int) -> None:
        self.slots, self.columns = 1 << bits, columns
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros((2, self.slots), np.uint64)
        self.values = np.zeros((self.columns, self.slots), np.int32)
        self.held = 0

    @property
    def full(self) -> bool:
        return self.held >= self.slots // 2

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each pair of keys (two rows), or -1."""
        out = np.full(keys.shape[1], -1, np.int64)
        todo = np.arange(keys.shape[1])
        slot = (keys[0] & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            there = self.keys[0, slot]
            hit = there == keys[0, todo]
            hit[hit] = self.keys[1, slot[hit]] == keys[1, todo[hit]]
            out[todo[hit]] = slot[hit]
            on = ~hit & (there != 0)
            todo, slot = todo[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct new pairs of keys with a column of numbers each; those beyond half of the slots aren't kept."""
        room = max(self.slots // 2 - self.held, 0)
        keys, values = keys[:, :room], values[:, :room]
        slot = (keys[0] & np.uint64(self.slots - 1)).astype(np.int64)
        while keys.shape[1]:
            free = self.keys[0, slot] == 0
            self.keys[0, slot[free]] = keys[0, free]
            self.keys[1, slot[free]] = keys[1, free]
            won = free & (self.keys[0, slot] == keys[0]) & (self.keys[1, slot] == keys[1])
            self.values[:, slot[won]] = values[:, won]
            self.held += int(won.sum())
            keys, values, slot = keys[:, ~won], values[:, ~won], (slot[~won] + 1) & (self.slots - 1)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each pair of keys, and for each pair which of these it equals."""
    _, first, which = np.unique(keys[0], return_index=True, return_inverse=True)
    odd = keys[1] != keys[1, first[which]]
    if odd.any():  # one first key with several second ones
        pairs = np.ascontiguousarray(keys.T).view([("a", np.uint64), ("b", np.uint64)]).ravel()
        _, first, which = np.unique(pairs, return_index=True, return_inverse=True)
    return first, which


class Store:
    """Numbers one behind the other; grows by doubling."""

    def __init__(self, dtype: str | np.dtype) -> None:
        self.flat = np.zeros(1 << 16, dtype)
        self.used = 0

    def add(self, parts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where each run of ``parts`` begins."""
        if self.used + len(parts) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(parts), self.flat.dtype)])
        self.flat[self.used : self.used + len(parts)] = parts
        at = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        self.used += len(parts)
        return at

    def gather(self, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs one behind the other, and their bounds."""
        ends = np.cumsum(size)
        out = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at - ends + size, size)]
        return out, np.concatenate([[0], ends])


def piece_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a byte begins, and whether it ends, a run without blank and line feed; runs end with their document."""
    ink = (data != 0x20) & (data != 0x0A)
    begins, ends = ink.copy(), ink.copy()
    begins[1:] &= ~ink[:-1]
    ends[:-1] &= ~ink[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner], ends[inner - 1] = ink[inner], ink[inner - 1]
    return begins, ends


def piece_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two keys of each piece; the first is never zero."""
    keys = span_keys(data, start, end, 2)
    np.maximum(keys[0], np.uint64(1), out=keys[0])
    return keys


def portions(data: np.ndarray, size: int = PORTION) -> Iterator[np.ndarray]:
    """A long text in portions that end behind a blank or a line feed; without one the portion grows."""
    at = 0
    while at < len(data):
        end, step, seen = len(data), size, at
        while at + step < len(data):
            blank = np.flatnonzero((data[seen : at + step] == 0x20) | (data[seen : at + step] == 0x0A))
            if len(blank):
                end = seen + int(blank[-1]) + 1
                break
            seen, step = at + step, step * 2
        yield data[at:end]
        at = end
