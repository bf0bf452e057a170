"""Bit votes over runs of hashes, with numpy: how many hashes of a run have each bit set."""

from __future__ import annotations

import numpy as np

#: For each byte, its eight bits spread over the eight bytes of one word (lowest bit first).
_SPREAD = (
    ((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(1))
    << (np.arange(8, dtype=np.uint64) * np.uint64(8))
).sum(axis=1, dtype=np.uint64)


def bit_counts(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per run of `lengths`, the number of rows of `hashes` (n, words) uint64 with each bit set; empty runs give zeros.

    Eight counters share a word, so sums are taken over at most 255 rows before they are widened.
    """
    n_bits = hashes.shape[1] * 64
    out = np.zeros((len(lengths), n_bits), dtype=np.int64)
    filled = np.flatnonzero(lengths)
    if not len(filled):
        return out
    size = lengths[filled]
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    parts = (size + 254) // 255
    part_first = np.concatenate(([0], np.cumsum(parts)[:-1]))
    within = np.arange(parts.sum()) - np.repeat(part_first, parts)
    starts = np.repeat(first, parts) + 255 * within
    lanes = _SPREAD[np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), -1)]
    sums = np.add.reduceat(lanes, starts, axis=0).view(np.uint8).reshape(len(starts), n_bits)
    out[filled] = np.add.reduceat(sums.astype(np.int64), part_first, axis=0)
    return out


def pack_bits(flags: np.ndarray) -> np.ndarray:
    """(n, 64 k) booleans to (n, k) uint64; column i is bit i % 64 of word i // 64."""
    return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)
