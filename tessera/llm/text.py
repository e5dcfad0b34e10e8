"""Vectorised text kernel: whole Arrow batches to words, hashes and spans.

A word is a maximal run of bytes outside ``{0x20, 0x09-0x0D}``, which on UTF-8 is
exactly the pattern ``[^\\x20\\x09-\\x0D]+``.  All functions work on byte arrays
with document offsets, so their cost is a few numpy passes over the bytes and
nothing per document or per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE_LOWER = _TABLE[_LOWER]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_pow: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _powers(kind: str, n: int) -> np.ndarray:
    have = _pow[kind]
    if len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        base = np.full(size, _P if kind == "p" else _PINV, np.uint64)
        base[0] = 1
        with np.errstate(over="ignore"):
            have = _pow[kind] = np.cumprod(base, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(33))
        h = h * U64(0xFF51AFD7ED558CCD)
        h ^= h >> U64(33)
        h *= U64(0xC4CEB9FE1A85EC53)
        h ^= h >> U64(33)
    return h


class Texts:
    """Bytes of a few whole documents: ``buf`` and ``offs`` (n + 1 offsets)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lo: int = 0):
        self.buf, self.offs, self.lo, self.n = buf, offs, lo, len(offs) - 1
        self._sums: dict[bool, np.ndarray] = {}

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs where ``inside`` holds, cut at documents."""
        if not len(inside):
            z = np.zeros(0, np.int64)
            return z, z
        cut = self.offs[(self.offs > 0) & (self.offs < len(inside))]
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[1:], before[0] = inside[:-1], False
        after[:-1], after[-1] = inside[1:], False
        before[cut] = False
        after[cut - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, and for each document the offset of its first word (n + 1)."""
        starts, ends = self.runs(~SPACE[self.buf])
        return starts, ends, np.searchsorted(starts, self.offs)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
        """64-bit hash of each span; equal bytes give equal hashes."""
        if lower not in self._sums:
            sums = np.zeros(len(self.buf) + 1, np.uint64)
            with np.errstate(over="ignore"):
                vals = (_TABLE_LOWER if lower else _TABLE)[self.buf]
                vals *= _powers("p", len(self.buf))
                np.cumsum(vals, out=sums[1:])
            self._sums[lower] = sums
        sums = self._sums[lower]
        with np.errstate(over="ignore"):
            h = sums[ends] - sums[starts]
            h *= _powers("i", len(self.buf) + 1)[starts]
        return mix(h)


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without copying; nulls are empty."""
    arr = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_string(arr.type) and not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.string())
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offs


def pieces(batch: pa.RecordBatch, name: str = "text", target: int = 1 << 19) -> Iterator[tuple[int, int, Texts]]:
    """Rows [lo, hi) of a batch with about ``target`` bytes of whole texts."""
    buf, offs = column(batch, name)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + target, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, Texts(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lo)
        lo = hi


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hash of every ``n`` neighbouring values, across documents too."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out *= U64(_P)
            out += h[i : i + m]
    return mix(out)


def owners(woffs: np.ndarray) -> np.ndarray:
    """Document of each word."""
    return np.repeat(np.arange(len(woffs) - 1), np.diff(woffs))
