"""Vectorised scans of UTF-8 text: prefix polynomial hashes, words and sliding minima, with NumPy.

Hashes of arbitrary substrings are polynomials modulo 2^64 over one random 64-bit value per byte. With an odd base the
power of a position can be divided out, so that they come from two prefix sums. Texts can be built that collide there,
so such hashes are compared only where bytes are verified after. Words are hashed by tabulation instead: the sum of one
random value for each pair of a byte and its place in the word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(0x5EED)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
SLICE = 1 << 19

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]), SLICE)
        for k, base in enumerate((BASE, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: close inputs get unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte values times powers; one more entry than data."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=out[1:])
    return out


def substring(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] from prefix sums: equal substrings have equal hashes."""
    _, down = powers(len(p))
    return (p[end] - p[start]) * down[start]


_PLACES = 64


def _placed(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return mix(mix((place.astype(np.uint64) << np.uint64(8)) + byte + np.uint64(0xB17E5)) ^ np.uint64(BASE))


PLACED = _placed(np.repeat(np.arange(_PLACES), 256), np.tile(np.arange(256, dtype=np.uint64), _PLACES))


def tabulated(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], which don't overlap and ascend: equal bytes have equal hashes, wherever they are."""
    if not len(start):
        return np.zeros(0, np.uint64)
    body = data[start[0] :]
    place = np.arange(len(body)) - np.repeat(start - start[0], np.diff(np.append(start, len(data))))
    value = PLACED[(np.minimum(place, _PLACES - 1) << 8) | body]
    far = np.flatnonzero(place >= _PLACES)
    value[far] = _placed(place[far], body[far])
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(value, out=sums[1:])
    return mix(sums[end - start[0]] - sums[start - start[0]] + (end - start).astype(np.uint64))


#: A-Z lowered, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are no part of words: ASCII white space; or all ASCII characters except letters and digits.
SPACE = np.isin(np.arange(256), list(b"\x20\x09\x0a\x0b\x0c\x0d"))
MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def slices(ids: pa.Array, texts: pa.Array, limit: int = SLICE):
    """Runs of rows with up to limit bytes of text, but one row at least: (ids, bytes, offsets). Null texts are empty."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield ids.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, separates: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words with A-Z lowered, their starts and ends, and for each row the number of words before it (one entry more)."""
    inside = np.zeros(len(data) + 2, np.bool_)
    inside[1:-1] = ~separates[data]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] = inside[cut + 1]
    ends[cut - 1] = inside[cut]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return tabulated(LOWER[data], start, end), start, end, np.searchsorted(start, offsets)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive words; fewer words than k give none."""
    if len(h) < k:
        return h[:0]
    up, _ = powers(k)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out += h[j : len(h) - k + 1 + j] * up[j]
    return mix(out + np.uint64(k))


def whole(h: np.ndarray) -> np.ndarray:
    """One hash of a whole sequence of words."""
    up, _ = powers(len(h))
    return mix(np.sum(h * up[: len(h)], dtype=np.uint64, keepdims=True) + np.uint64(len(h)))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
