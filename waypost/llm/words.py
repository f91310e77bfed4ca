"""Words and shingles of whole batches of texts, as numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z
lower-cased. No byte of a multi-byte UTF-8 character is one of these, so
working on bytes equals working on characters.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A random 64-bit value for each lower-cased byte, so that word hashes do not
#: depend on the numeric pattern of the bytes.
_BYTE = np.random.default_rng(20240117).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes hashed at a time.
_WINDOW = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done, step = 1, base
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * np.uint64(step)
        step = step * step % 2**64
        done += k
    return out


class WordHasher:
    """Hashes every word of a batch; keeps the powers it needs between batches."""

    def __init__(self) -> None:
        self._up = _powers(_BASE, 1)
        self._down = _powers(_INVERSE, 1)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and how many each text has."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        space = _SPACE[data]
        hashes, starts, at = [], [], 0
        while at < len(data):  # in windows that end at a separator, so that memory does not grow with a text
            to = min(at + _WINDOW, len(data))
            if not space[to - 1]:
                back = np.flatnonzero(space[at:to])
                to = at + back[-1] + 1 if len(back) else to + int(np.argmax(space[to:])) + 1
            h, s = self._window(data[at:to], space[at:to])
            hashes.append(h)
            starts.append(s + at)
            at = to
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        bounds = np.searchsorted(np.concatenate(starts), np.concatenate([[0], np.cumsum(lengths)]))
        return np.concatenate(hashes), np.diff(bounds)

    def _window(self, data: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(data) > len(self._up):
            self._up = _powers(_BASE, len(data))
            self._down = _powers(_INVERSE, len(data))
        edge = np.diff(space.view(np.int8), prepend=np.int8(1))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.cumsum(_BYTE[data] * self._up[: len(data)], dtype=np.uint64)
        before = np.concatenate([np.zeros(1, dtype=np.uint64), total])
        return mix64((before[ends] - before[starts]) * self._down[starts]), starts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles of each text in order, and their number.

    A text with fewer words has its whole sequence as one shingle, a text
    without words none.
    """
    n = len(words)
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    if not n:
        return np.empty(0, dtype=np.uint64), sizes
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes) + np.arange(sizes.sum())
    span = np.repeat(np.minimum(counts, width), sizes)
    out = mix64(span.astype(np.uint64))
    for k in range(width):
        here = words[np.minimum(first + k, n - 1)]
        out = np.where(k < span, mix64(out * np.uint64(_BASE) + here), out)
    return out, sizes
