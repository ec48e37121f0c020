"""Open hash tables of 64-bit keys in arrays, searched for many keys at once."""

from __future__ import annotations

import numpy as np

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return (((keys + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def table(keys: np.ndarray, values: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, int], np.ndarray]:
    """An index of distinct keys below 2^64 - 1 (slots of keys, their places in values, probes at most), and the values."""
    bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
    slots, places = np.full(1 << bits, _EMPTY), np.full(1 << bits, -1, np.int32)
    todo, at, probes = np.arange(len(keys)), _slot(keys, bits), 0
    while len(todo):
        probes += 1
        free = slots[at] == _EMPTY
        # Of the keys that want one free slot, the last written has it.
        slots[at[free]], places[at[free]] = keys[todo[free]], todo[free]
        placed = places[at] == todo
        todo, at = todo[~placed], (at[~placed] + 1) & ((1 << bits) - 1)
    return (slots, places, probes), values


def find(index: tuple[np.ndarray, np.ndarray, int], keys: np.ndarray) -> np.ndarray:
    """The places of the keys, -1 for those the table lacks."""
    slots, places, probes = index
    bits = len(slots).bit_length() - 1
    at = _slot(keys, bits)
    there = slots[at]
    out = np.where(there == keys, places[at], -1)
    todo = np.flatnonzero((there != keys) & (there != _EMPTY))
    for _ in range(1, probes):
        if not len(todo):
            break
        at[todo] = (at[todo] + 1) & (len(slots) - 1)
        there = slots[at[todo]]
        hit = there == keys[todo]
        out[todo[hit]] = places[at[todo[hit]]]
        todo = todo[~hit & (there != _EMPTY)]
    return out
