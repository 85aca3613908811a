"""Vectorised text primitives over Arrow string buffers.

Each function works on a byte buffer that holds many texts one after the other, so
per-word work is a numpy expression and not a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_BYTE_CODE = np.random.default_rng(0x5EED).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C55 | 3)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
#: Bytes of text handled at once; bounds a worker's memory whatever the batch size.
SLICE_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n+1 offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = at.astype(np.int64)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes; a longer text stands alone, whole."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def words(buf: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n+1 offsets of each text's words; breaks: of each byte, whether it stands between words."""
    if len(buf) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~breaks[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(buf), bool)
    before[0], before[1:] = False, solid[:-1]
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = False, solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: The powers that slices need, worked out once a process; longer texts work out their own.
_KNOWN: dict[int, np.ndarray] = {}


def _powers(n: int, base: np.uint64) -> np.ndarray:
    if n > SLICE_BYTES + 1:
        return powers(n, base)
    if int(base) not in _KNOWN:
        _KNOWN[int(base)] = powers(SLICE_BYTES + 1, base)
    return _KNOWN[int(base)][:n]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each span; fold lower-cases A-Z first. Equal bytes, equal hash, anywhere."""
    code = _BYTE_CODE[_FOLD[buf]] if fold else _BYTE_CODE[buf]
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(code * _powers(len(buf), _STEP), out=total[1:], dtype=np.uint64)
    h = (total[ends] - total[starts]) * _powers(len(buf) + 1, _BACK)[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the spans of a and b, of the given sizes, have the same bytes."""
    step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    differs = a[np.repeat(a_at, sizes) + step] != b[np.repeat(b_at, sizes) + step]
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=differs, minlength=len(sizes)) == 0


def pair_hash(a: np.ndarray, b: np.ndarray, salt: int = 1) -> np.ndarray:
    """A 64-bit hash of an ordered pair of hashes."""
    return mix(a * np.uint64(0x9FB21C651E98DF25) + b * np.uint64(0xD6E8FEB86659FD93) + np.uint64(salt))


def window_hashes(h: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of `width` items (all of it if it has fewer; none if it has none), and their n+1 offsets."""
    counts = np.diff(offsets)
    n_out = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(n_out)])
    if len(h) == 0:
        return np.zeros(0, np.uint64), at
    doc = np.repeat(np.arange(len(counts)), n_out)
    first = offsets[:-1][doc] + np.arange(at[-1]) - at[:-1][doc]
    size = np.minimum(counts[doc], width)
    out = size.astype(np.uint64)
    for k in range(width):
        inside = k < size
        out = np.where(inside, pair_hash(out, h[np.minimum(first + k, len(h) - 1)], 3), out)
    return out, at
