"""Hashes of words and word shingles of whole Arrow batches, vectorised."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACES = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_BYTES = np.arange(256)
#: What a byte counts in a hash, A-Z as a-z, and whether it is part of a word.
_VALUES = (_BYTES + np.where((_BYTES >= 65) & (_BYTES <= 90), 33, 1)).astype(np.uint64)
_BLACK = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: Bytes of texts that are hashed at once (a longer text is hashed whole).
RUN = 1 << 18
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, f, np.uint64)])) for f in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def word_hashes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and the offsets of each text's words in them.

    Words are runs of anything but ASCII white space. The hash is a polynomial
    of the bytes modulo 2**64, out of prefix sums, mixed with the length.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    black = _BLACK[data]
    before = np.concatenate([[False], black[:-1]])
    before[bounds[:-1][bounds[:-1] < n]] = False
    after = np.concatenate([black[1:], [False]])
    inner = bounds[1:] - 1
    after[inner[inner >= 0]] = False
    starts, ends = np.flatnonzero(black & ~before), np.flatnonzero(black & ~after) + 1
    power, inverse = _power_tables(n)
    value = _VALUES[data]
    value *= power[:n]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=sums[1:])
    words = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(words + (ends - starts).astype(np.uint64) * _PLACES[0]), np.searchsorted(starts, bounds)


def shingles(words: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; of fewer words than ``size``, the whole sequence is the only one."""
    runs = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for j in range(size):
        runs += words[j : j + len(runs)] * _PLACES[j % len(_PLACES)] ** np.uint64(1 + j // len(_PLACES))
    runs = mix(runs)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for w in words[a:b]:
                whole = mix(np.array([whole * _PLACES[1] + w], np.uint64))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def text_shingles(texts: pa.StringArray, size: int = 5) -> list[np.ndarray]:
    """:func:`shingles` of an Arrow batch's texts, hashed in runs, as hashing takes many times the bytes of its texts."""
    if not len(texts):
        return []
    texts = texts.cast(pa.large_string())
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts)]
    cuts = [0, *(np.flatnonzero(np.diff((starts - starts[0]) // RUN)) + 1).tolist(), len(texts)]
    out = []
    with np.errstate(over="ignore"):
        for a, b in zip(cuts, cuts[1:]):
            out += shingles(*word_hashes(texts[a:b]), size)
    return out
