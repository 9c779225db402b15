"""Whole texts as NumPy arrays inside Arrow tasks.

Every helper works on a *slice*: some consecutive texts of one Arrow batch, laid
out as one byte buffer with ``offsets`` (``offsets[i]:offsets[i+1]`` is text i).
A slice holds about ``SLICE_BYTES``; a longer text makes a slice of its own, so no
text is ever cut and memory follows the slice, not the batch.

Words are the runs of ``[^\\x20\\x09-\\x0D]``; all six separators are ASCII, so the
UTF-8 bytes can be scanned directly.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U = np.uint64
_R = 0x9E3779B97F4A7C13  # odd, hence invertible modulo 2**64
_RINV = pow(_R, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


class Slice(NamedTuple):
    first: int            # row of the batch of the first text
    buf: np.ndarray       # uint8
    offsets: np.ndarray   # int64, one more than texts


class Words(NamedTuple):
    starts: np.ndarray    # byte positions
    ends: np.ndarray
    ptr: np.ndarray       # words of text i are ptr[i]:ptr[i+1]


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n)
        yield Slice(lo, raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~_SPACE[buf]
    n = len(buf)
    before = np.zeros(n, dtype=bool)
    after = np.zeros(n, dtype=bool)
    if n:
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        before[cuts] = False
        after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _pow(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=_U)
        steps[0] = 1
        have = np.cumprod(steps, dtype=_U)
        if n <= 4 * SLICE_BYTES:
            _powers[name] = have
    return have[:n]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes give equal hashes anywhere."""
    n = len(buf)
    terms = (_LOWER[buf] if lower else buf).astype(_U)
    terms += _U(1)
    terms *= _pow("r", _R, n)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(terms, out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * _pow("rinv", _RINV, n + 1)[starts])


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of 64-bit values, in order; also of its length."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(mix64(values) * _pow("r", _R, n), out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * _pow("rinv", _RINV, n + 1)[starts] + (ends - starts).astype(_U))


_K = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(16)], dtype=_U)


def windows(hashes: np.ndarray, ptr: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows inside each text and their ptr.

    Texts with fewer words have none.
    """
    counts = np.maximum(np.diff(ptr) - (width - 1), 0)
    out_ptr = np.concatenate([[0], np.cumsum(counts)])
    total = int(out_ptr[-1])
    if total == 0:
        return np.zeros(0, dtype=_U), out_ptr
    at = np.arange(total) + np.repeat(ptr[:-1] - out_ptr[:-1], counts)
    acc = hashes[at] * _K[0]
    for k in range(1, width):
        acc += hashes[at + k] * _K[k]
    return mix64(acc), out_ptr


def owner(ptr: np.ndarray) -> np.ndarray:
    """Text number of every item."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sum of the items of every text."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[ptr[1:]] - total[ptr[:-1]]


def as_int64(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
