"""Vectorised hashing of words and word shingles of whole texts, with numpy inside a task.

A batch of texts is joined into one byte buffer; words are runs of non-white bytes, hashed by a polynomial over all
bytes at once, so the work per byte is a few array passes and nothing is done per word in Python. Hashes have 64 bits;
two different shingles of one pair of documents collide with a probability near 2**-40 even for texts of a million words.
"""

from __future__ import annotations

import numpy as np

_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)


def _splitmix(n: int, seed: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_R)) + np.uint64(seed)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_T = _splitmix(256, 7)
_SHINGLE = _splitmix(64, 11) | np.uint64(1)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW["r"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("r", _R), ("i", _R_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POW[name] = np.cumprod(p, dtype=np.uint64)
    return _POW["r"], _POW["i"]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and for each text the index of its first word (one more at the end).

    A-Z are lower-cased; a null text has no words.
    """
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in texts]
    buf = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts)))
    solid = ~_WHITE[buf]
    edge = np.diff(solid.view(np.int8), prepend=np.int8(0))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    r, inv = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_T[buf] * r[: len(buf)], out=total[1:])
    words = mix((total[stop] - total[start]) * inv[start] + (stop - start).astype(np.uint64))
    first = np.zeros(len(parts) + 1, dtype=np.int64)
    first[1:] = np.searchsorted(start, ends)
    return words, first


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """For each text its distinct k-word shingles as sorted 64-bit hashes; with 1 to k-1 words the whole sequence is one."""
    words, first = word_hashes(texts)
    n = len(words)
    grams = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        if n > j:
            grams[: n - j] += words[j:] * _SHINGLE[j]
    grams = mix(grams)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            s = np.sort(grams[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            whole = (words[a:b] * _SHINGLE[k : k + b - a]).sum(keepdims=True, dtype=np.uint64)
            out.append(mix(whole + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def batches(*columns, most_bytes: int = 1 << 20):
    """Slices of rows of Arrow string columns as lists (one per column), with about most_bytes bytes together and at least
    one row each, so that only a slice is held as Python strings."""
    import pyarrow.compute as pc

    size = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    upto, a = np.cumsum(size), 0
    while a < len(upto):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most_bytes, side="right")))
        yield [c.slice(a, b - a).to_pylist() for c in columns]
        a = b
