"""64-bit hashes of all words of many texts at once."""

from __future__ import annotations

import numpy as np

_PRIME = np.uint64(0x100000001B3)
_BASIS = np.uint64(0xCBF29CE484222325)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a word that are hashed side by side with other words; longer words are hashed alone.
_SHORT = 48


def word_hashes(texts: list[str | None], endings: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes of the words of ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, in order; and how many each text has.

    With ``endings``, also the last two bytes of each word as a number.

    The bytes of the texts are one array; the hashes of all words take in their
    first bytes, then their second ones, and so on.
    """
    import xxhash

    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = b"\n".join(parts).lower() + b"\n"  # of bytes, this changes A-Z only
    a = np.frombuffer(data, np.uint8)
    space = _SPACE[a]
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        change = np.concatenate([[0], change])
    starts, ends = change[::2], change[1::2]
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    at, size = starts[order], sizes[order]
    h = np.full(len(at), _BASIS)
    for j in range(min(_SHORT, int(size[0]) if len(size) else 0)):
        k = int(np.searchsorted(-size, -j, "left"))  # words longer than j
        h[:k] = (h[:k] ^ a[at[:k] + j]) * _PRIME
    for i in range(int(np.searchsorted(-size, -_SHORT, "left"))):
        h[i] = xxhash.xxh64_intdigest(data[at[i] : at[i] + size[i]])
    h ^= h >> np.uint64(32)
    out = np.empty_like(h)
    out[order] = h * np.uint64(0x9E3779B97F4A7C15)
    firsts = np.cumsum([0, *(len(p) + 1 for p in parts)])
    counts = np.diff(np.searchsorted(starts, firsts))
    if not endings:
        return out, counts
    return out, counts, a[ends - 1] + 256 * np.where(sizes > 1, a[ends - 2], 0).astype(np.int32)
