"""Array kernels over many texts at once: word shingles and byte windows.

A span's hash is a polynomial in its bytes modulo 2**64, read off prefix sums
(the base is odd, so it has an inverse and every span can be brought to the
same origin), followed by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_U = np.uint64

#: Words are runs of other bytes than these.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(29))
    x = x * _U(0xA24BAED4963EE407)
    return x ^ (x >> _U(32))


class _Powers:
    def __init__(self, base: int):
        self.base, self.table = _U(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            step = self.table[-1:] * self.base
            self.table = np.concatenate([self.table, self.table * step])
        return self.table[:n]


_FORTH, _BACK = _Powers(BASE), _Powers(INVERSE)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums S with hash(a, b) = (S[b] - S[a]) * BASE**-a."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * _FORTH.upto(len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _BACK.upto(len(sums))[start] + end.astype(np.uint64) - start.astype(np.uint64))


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` bytes."""
    n = len(sums) - width
    return mix((sums[width:] - sums[:n]) * _BACK.upto(n)) if n > 0 else np.zeros(0, np.uint64)


def text_groups(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive texts of about ``most_bytes``: (first, last + 1, bytes, ends).

    The bytes are the texts with one space after each; a null counts as empty.
    ``ends`` are the texts' ends in it.  A longer text is a group by itself.
    """
    first, parts, size = 0, [], 0
    for k in range(len(column)):
        part = column[k].as_buffer()
        parts.append(part.to_pybytes() if part is not None else b"")
        size += len(parts[-1]) + 1
        if size >= most_bytes or k + 1 == len(column):
            lengths = np.array([len(p) + 1 for p in parts], np.int64)
            yield first, k + 1, np.frombuffer(b" ".join(parts) + b" ", np.uint8), np.cumsum(lengths) - 1
            first, parts, size = k + 1, [], 0


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int = 5) -> list[np.ndarray]:
    """Sorted distinct word-shingle hashes of each text.

    A-Z count as a-z.  A text of fewer words has its whole sequence as the one
    shingle; a text without words has none.
    """
    data = _LOWER[data]
    inside = _IS_WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    word = span_hashes(prefix_sums(data), start, end)
    owner = np.searchsorted(start, np.concatenate([[0], ends]), "left")  # words before each text's start
    factor = _FORTH.upto(words + 1)
    n = max(len(word) - words + 1, 0)
    acc = np.zeros(n, np.uint64)
    for k in range(words):
        acc += word[k : k + n] * factor[k]
    shingle = mix(acc)
    out = []
    for a, b in zip(owner, owner[1:]):
        if b - a >= words:
            out.append(np.unique(shingle[a : b - words + 1]))
        elif b > a:
            out.append(mix(np.array([(word[a:b] * factor[: b - a]).sum(dtype=np.uint64) + _U(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value (by its leading 36 bits) of every
    window of ``width``; at most 2**28 values."""
    if len(values) > 1 << 28:
        raise ValueError("a text of more than 2**28 bytes")
    low = _U((1 << 28) - 1)
    best, span = (values & ~low) | np.arange(len(values), dtype=np.uint64), 1
    while span < width and len(best):
        step = min(span, width - span)
        best = np.minimum(best[:-step], best[step:]) if len(best) > step else best[:0]
        span += step
    return (best & low).astype(np.int64)
