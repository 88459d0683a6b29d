"""Vectorised scans over UTF-8 texts as they arrive in Arrow batches.

Words, shingles and fixed-length windows are hashed to 64 bits with a
polynomial over all bytes of a slice at once (prefix sums modulo 2**64)
and a bit mixer, so no Python code runs per word or per byte.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that one vectorised step looks at; bounds the memory of a task.
SLICE = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows (null: empty)."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset:column.offset + n + 1].astype(np.int64) \
        if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    size = max(SLICE, 1 << (max(n, 1) - 1).bit_length())
    return _powers(base, size)[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences hash any slice (see ``span_hash``)."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = powers(BASE_INVERSE, len(prefix))
    h = (prefix[end] - prefix[start]) * inverse[start]
    return mix(h + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def slices(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``SLICE`` bytes; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _words(data: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ``space``."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~space[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(raw: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE
                ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For row ranges of a batch: (first row, end row, hashes of the
    lower-cased words, for each row the position of its first word).

    A row longer than a slice is read piece by piece, cut at white space.
    """
    for i, j in slices(raw, off):
        lo, hi = int(off[i]), int(off[j])
        if j - i > 1 or hi - lo <= 2 * SLICE:
            data = _LOWER[raw[lo:hi]]
            cuts = off[i + 1:j] - lo
            s, e = _words(data, space)
            if len(cuts):  # a word ends where its row ends
                inner = cuts[(cuts > 0) & (cuts < len(data))]
                k = np.searchsorted(s, inner, "right") - 1
                ok = k >= 0
                split = inner[ok][(s[k[ok]] < inner[ok]) & (e[k[ok]] > inner[ok])]
                split = np.unique(split)
                s, e = np.sort(np.concatenate([s, split])), np.sort(np.concatenate([e, split]))
            h = span_hash(prefix_hash(data), s, e) if len(s) else np.zeros(0, U)
            yield i, j, h, np.searchsorted(s, off[i:j + 1] - lo, "left")
            continue
        parts, at = [], lo
        while at < hi:
            end = min(hi, at + SLICE)
            while end < hi:
                gap = np.flatnonzero(space[raw[at:end]])
                if len(gap):
                    end = at + int(gap[-1]) + 1
                    break
                end = min(hi, end + SLICE)
            data = _LOWER[raw[at:end]]
            s, e = _words(data, space)
            if len(s):
                parts.append(span_hash(prefix_hash(data), s, e))
            at = end
        h = np.concatenate(parts) if parts else np.zeros(0, U)
        yield i, j, h, np.array([0, len(h)])


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text; with fewer words, of the
    whole sequence as one; none without words."""
    n = len(words)
    if n == 0:
        return np.zeros(0, U)
    width = min(k, n)
    h = np.zeros(n - width + 1, U)
    for i in range(width):
        h = h * U(0x2545F4914F6CDD1D) + words[i:n - width + 1 + i]
    return mix(h + U(width))
