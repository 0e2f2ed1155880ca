"""Words of a block of texts given as bytes, and sums over equal 64-bit keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 byte values belong to a word: those outside the given ranges."""
    member = np.ones(256, bool)
    for low, high in ranges:
        member[low:high + 1] = False
    return member


def spans(data: np.ndarray, starts: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of each longest run of member bytes; rows begin at ``starts``, the last entry is the end."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = member[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    edge[0] = edge[-1] = True
    begins = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return begins, ends, np.searchsorted(starts, begins, "right") - 1


def gather(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings at some ranges of a byte array."""
    sizes = ends - begins
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    taken = data[np.arange(offsets[-1]) + np.repeat(begins - offsets[:-1], sizes)]
    return pa.Array.from_buffers(pa.large_utf8(), len(sizes),
                                 [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(taken))])


def sum_by_key(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For the distinct keys in ascending order: a place where each stands, and the sums of its values."""
    order = np.argsort(key, kind="stable")
    if not len(order):
        return order, [v[:0] for v in values]
    ranked = key[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return order[first], [np.add.reduceat(v[order], first) for v in values]
