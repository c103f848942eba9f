"""Words of whole texts as Arrow arrays, found in one pass over the bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] = LOWER[97:123]  # A-Z


def byte_set(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


def word_edges(data: np.ndarray, starts: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words open and close: runs of bytes that are not in ``between``; texts never share a word."""
    word = ~between[data] if len(data) else np.zeros(0, bool)
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    before = np.concatenate(([False], word))
    after = np.concatenate((word, [False]))
    return np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))


def word_array(data: np.ndarray, opens: np.ndarray, closes: np.ndarray, lower: bool = True) -> pa.StringArray:
    """The words between ``opens`` and ``closes``, A-Z as a-z."""
    sizes = closes - opens
    ends = np.cumsum(sizes)
    if len(ends) and ends[-1] >= 1 << 31:
        raise ValueError("more than 2 GB of words in one part")
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    at = np.arange(offsets[-1], dtype=np.int32) + np.repeat((opens - offsets[:-1]).astype(np.int32), sizes)
    used = data[at]
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(LOWER[used] if lower else used))
