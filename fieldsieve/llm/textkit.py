"""Word and shingle hashes of whole Arrow string arrays, without a Python step for each word.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the lower-cased text.
Hashes are 64-bit: a polynomial over random byte values, folded by a finaliser. Texts of any length
are worked off in blocks of bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
_BLOCK = 1 << 16
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers by rule."""
    return mix(_U(seed) + _U(0x9E3779B97F4A7C15) * np.arange(1, n + 1, dtype=_U))


_BYTES = stream(11, 256)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWER = np.cumprod(np.full(_BLOCK, _BASE, _U)) * _U(pow(_BASE, -1, 1 << 64))  # base^0 ..
_INVERSE = np.cumprod(np.full(_BLOCK, pow(_BASE, -1, 1 << 64), _U)) * _U(_BASE)
_WORD = np.zeros(256, np.uint8)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and where each text begins (with the end)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    base = int(offsets[0]) if len(offsets) else 0
    size = int(offsets[-1]) - base if len(offsets) else 0
    return (np.frombuffer(data, np.uint8, size, base) if data is not None and size else np.zeros(0, np.uint8)), offsets - base


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range; starts and ends ascend and ranges don't overlap."""
    at_start, at_end = np.empty(len(starts), _U), np.empty(len(starts), _U)
    total, power, inverse = _U(0), 1, 1
    scale = np.empty(len(starts), _U)
    step, back = pow(_BASE, _BLOCK, 1 << 64), pow(pow(_BASE, -1, 1 << 64), _BLOCK, 1 << 64)
    for at in range(0, len(data), _BLOCK):
        piece = data[at : at + _BLOCK]
        sums = np.empty(len(piece) + 1, _U)
        sums[0] = 0
        np.cumsum(_BYTES[piece] * _POWER[: len(piece)], out=sums[1:])
        sums = sums * _U(power) + total
        last = at + len(piece) >= len(data)
        i, j = np.searchsorted(starts, [at, at + len(piece)])
        at_start[i:j] = sums[starts[i:j] - at]
        scale[i:j] = _INVERSE[starts[i:j] - at] * _U(inverse)
        i, j = np.searchsorted(ends, [at + (at > 0), at + len(piece) + 1 if last else at + len(piece) + 1])
        at_end[i:j] = sums[ends[i:j] - at]
        total = sums[-1]
        power, inverse = power * step % (1 << 64), inverse * back % (1 << 64)
    return mix((at_end - at_start) * scale)


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the maximal runs of bytes marked in ``inside`` begin and end, and where each text's begin (with the end); none crosses texts."""
    mark = np.zeros(len(data) + 2, np.int8)
    mark[1:-1] = inside[data]
    edge = np.diff(mark)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    if len(split := cut[(mark[cut] == 1) & (mark[cut + 1] == 1)]):
        starts, ends = np.sort(np.concatenate((starts, split))), np.sort(np.concatenate((ends, split)))
    return starts, ends, np.searchsorted(starts, offsets)


_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lowered."""
    return _ASCII_LOWER[data]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, where each text's words begin (with the end), and the words' byte ranges in the
    lower-cased texts put end to end."""
    data, offsets = utf8(pc.utf8_lower(texts))
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _WORD[data]
    edge = np.diff(inside)
    # a text's end also ends its last word
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    split = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
    starts = np.flatnonzero(edge == 1)
    ends = np.flatnonzero(edge == -1)
    if len(split):
        starts, ends = np.sort(np.concatenate((starts, split))), np.sort(np.concatenate((ends, split)))
    return range_hashes(data, starts, ends), np.searchsorted(starts, offsets), starts, ends


_SHIFT = stream(12, 64) | _U(1)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, and where each text's begin. A text of fewer words has one, of all its words."""
    n = np.diff(bounds)
    padded = np.concatenate((hashes, np.zeros(k, _U)))
    whole = np.zeros(len(hashes), _U)
    left = np.repeat(bounds[1:], n) - np.arange(len(hashes))  # words from here to the text's end
    for j in range(k):
        part = padded[j : j + len(hashes)] * _SHIFT[j]
        whole += part if j == 0 else np.where(left > j, part, _U(0))
    keep = (left >= k) | (np.arange(len(hashes)) == np.repeat(bounds[:-1], n))
    counts = np.where(n == 0, 0, np.maximum(1, n - k + 1))
    return mix(whole[keep]), np.concatenate(([0], np.cumsum(counts)))


def distinct(hashes: np.ndarray, bounds: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct hashes in order, where they begin, and their counts (or summed weights)."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    value = np.ones(len(h)) if weights is None else weights[order]
    total = np.add.reduceat(value, at) if len(at) else np.zeros(0)
    return h[at], np.searchsorted(o[at], np.arange(len(bounds))), total


def digest128(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each text's sequence of hashes."""
    n, place = np.diff(bounds), np.arange(len(hashes), dtype=_U)
    local = place - np.repeat(bounds[:-1], n).astype(_U)
    out = []
    for seed in (0x632BE59BD9B4E019, 0xD6E8FEB86659FD93):
        total = np.concatenate((np.zeros(1, _U), np.cumsum(mix(hashes ^ mix(local * _U(seed) + _U(seed))))))
        out.append(mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(_U)))
    return out[0], out[1]
