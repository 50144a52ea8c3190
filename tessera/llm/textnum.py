"""Vectorised text work inside tasks: words, hashes and shingles of a batch of texts as numpy arrays.

Texts are laid end to end with one blank between them, in chunks of about ``CHUNK`` bytes, so memory
does not follow the batch size (a longer text is a chunk of its own).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Blank and the controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII letters and all bytes of other characters.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, bytes, starts)``: texts ``first .. last - 1``, each after one blank, and one blank at the end.

    Text i of the chunk begins at ``starts[i]`` and ends one before ``starts[i + 1]``.
    """
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (size < CHUNK or last == first):
            size += len(texts[last]) + 1
            last += 1
        buf = np.frombuffer(b" " + b" ".join(texts[first:last]) + b" ", np.uint8)
        starts = np.cumsum([1] + [len(t) + 1 for t in texts[first:last]])
        yield first, last, buf, starts
        first = last


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of True; the first and last entries are False."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edge[::2], edge[1::2]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
        up[0] = down[0] = 1
        k = 1
        while k < size:  # by doubling
            np.multiply(up[:k], up[k - 1] * BASE, out=up[k : 2 * k])
            np.multiply(down[:k], down[k - 1] * INVERSE, out=down[k : 2 * k])
            k *= 2
        _powers[size] = up, down
    return _powers[size]


def word_hashes(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def shingles(texts: list[bytes], size: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles.

    Words are lower-cased (A-Z) runs without white space; a text of fewer words has its whole sequence as
    one shingle, and a text without words has none.
    """
    odd = [np.uint64(int.from_bytes(hashlib.sha256(bytes([k])).digest()[:8], "big") | 1) for k in range(size)]
    with np.errstate(over="ignore"):
        for _, _, raw, starts in chunks(texts):
            buf = LOWER[raw]
            begin, end = spans(~SPACE[buf])
            h = word_hashes(buf, begin, end)
            at = np.searchsorted(begin, starts)
            if len(h) >= size:
                n = len(h) - size + 1
                s = h[:n] * odd[0]
                for k in range(1, size):
                    s = s + h[k : k + n] * odd[k]
                s = mix(s)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if b - a >= size:
                    yield np.unique(s[a : b - size + 1])
                elif b > a:
                    yield mix(np.array([sum((h[a + k] * odd[k] for k in range(b - a)), np.uint64(b - a))], np.uint64))
                else:
                    yield np.empty(0, np.uint64)
