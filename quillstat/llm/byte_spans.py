"""Spans of bytes in one buffer, taken eight bytes at a time by numpy."""

from __future__ import annotations

import numpy as np

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def buffer_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends of the texts in them) of an Arrow column of texts without nulls."""
    import pyarrow as pa

    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def padded(data: np.ndarray) -> np.ndarray:
    """``data`` with zeros after it, so that eight bytes can be taken at any of its places."""
    out = np.zeros((len(data) + 31) // 8 * 8, np.uint8)
    out[: len(data)] = data
    return out


def eight(blocks: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes of each span as a number, those beyond its end zero; ``blocks`` is a padded buffer seen as uint64."""
    at, shift = start >> 3, ((start & 7) << 3).astype(np.uint64)
    low = blocks[at] >> shift
    return (low | (blocks[at + 1] << np.uint64(1)) << (np.uint64(63) - shift)) & _MASK[np.minimum(size, 8)]


def text_heads(ends: np.ndarray, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, numbers) of the texts that have bytes in [at, to): where they begin in it, counted from ``at``."""
    heads = np.unique(np.concatenate([[0], ends[(ends > at) & (ends < to)] - at]))
    return heads, np.searchsorted(ends, heads + at, "right")


def runs(inside: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of the longest runs of true bytes; a run ends where another text begins."""
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:] = inside[:-1]
    before[heads] = False
    after[:-1] = inside[1:]
    after[heads[1:] - 1] = False
    start = np.flatnonzero(inside & ~before)
    return start, np.flatnonzero(inside & ~after) + 1 - start


def piece_end(outside: np.ndarray, data: np.ndarray, at: int, most: int) -> int:
    """Where a piece of about ``most`` bytes from ``at`` may end without cutting a run: at the end or a byte for which ``outside`` (a table of 256) holds."""
    to = min(len(data), at + most)
    while to < len(data):
        free = np.flatnonzero(outside[data[to : to + most]])
        if len(free):
            return to + int(free[0])
        to = min(len(data), to + most)
    return to
