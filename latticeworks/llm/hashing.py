"""Vectorised words and hashes over runs of UTF-8 texts (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
# ASCII bytes that are neither letter nor digit; bytes of other scripts belong to words.
_NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = U(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: U, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


_POW = _powers(_BASE, 64)


def _power_table(n: int) -> np.ndarray:
    global _POW
    if n > len(_POW):
        _POW = _powers(_BASE, 2 * n)
    return _POW


def flat(texts: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets with a last one)."""
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def spans(buf: np.ndarray, off: np.ndarray, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inside, start, end): which bytes belong to words, and the span of every word of every text."""
    inside = ~outside[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = off[(off > 0) & (off < len(buf))]  # a word ends where its text ends
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    return inside, np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """Words of some texts: hash, byte span, and where each text's words begin."""

    def __init__(self, texts: pa.LargeBinaryArray, lower: bool = False, alnum: bool = False):
        buf, off = flat(texts)
        if lower:
            buf = _LOWER[buf]
        self.buf = buf
        _, self.start, self.end = spans(buf, off, _NOT_ALNUM if alnum else _SPACE)
        self.text_at = np.searchsorted(self.start, off)
        self.offsets = off
        self.hash = self.head(None)

    def head(self, length: int | None) -> np.ndarray:
        """Hash of the first ``length`` bytes of every word (None: all)."""
        if not len(self.start):
            return np.zeros(0, U)
        end = self.end if length is None else np.minimum(self.end, self.start + length)
        return hash_spans(self.buf, self.start, end)


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each non-empty span of bytes; spans are in order and don't overlap."""
    size = end - start
    total = np.cumsum(size)
    step = np.ones(total[-1], np.int64)
    step[0] = start[0]
    step[total[:-1]] = start[1:] - end[:-1] + 1
    at = np.cumsum(step)  # places of all the spans' bytes
    head = total - size
    place = np.arange(total[-1]) - np.repeat(head, size)
    terms = (buf[at].astype(U) + U(1)) * _power_table(int(size.max()))[place]
    return mix(np.add.reduceat(terms, head) + size.astype(U))


def window_sums(words: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """64-bit hash of every run of ``width`` consecutive words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = U(base | 1), U(pow(base | 1, -1, 1 << 64))
    total = np.zeros(len(words) + 1, U)
    np.cumsum(words * _powers(up, len(words)), out=total[1:])
    return mix((total[width:] - total[:-width]) * _powers(down, n))
