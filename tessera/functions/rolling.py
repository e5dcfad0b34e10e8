"""The 29 families of rolling features over one window length, as arrays.

Sliding windows of Spark's go through a frame once more for each row and aggregate, and
its exact percentile builds a table of counts a row.  Here rows are sorted by symbol and
date, streamed in Arrow batches, and each batch is a matrix of (rows, window); the rows
that a symbol's next batch looks back on are carried along, so memory doesn't grow with
a symbol or a partition.  Nulls are NaN inside and null again outside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructType

E = 1e-12


class _Window:
    """A series' values in each row's window; nulls, and rows before the symbol's first, are left out."""

    def __init__(self, z: np.ndarray, idx: np.ndarray, inside: np.ndarray):
        self.z = np.where(inside, z[idx], np.nan)
        self.ok = ~np.isnan(self.z)
        self.zero = np.where(self.ok, self.z, 0.0)
        self.n = self.ok.sum(1)
        self.sum = np.where(self.n > 0, self.zero.sum(1), np.nan)
        self.mean = self.sum / self.n

    def off(self) -> np.ndarray:
        return np.where(self.ok, self.z - self.mean[:, None], 0.0)

    def std(self) -> np.ndarray:
        return np.where(self.n > 1, np.sqrt((self.off() ** 2).sum(1) / (self.n - 1)), np.nan)

    def top(self) -> np.ndarray:
        return np.fmax.reduce(self.z, axis=1)

    def bottom(self) -> np.ndarray:
        return np.fmin.reduce(self.z, axis=1)

    def place(self, best: np.ndarray) -> np.ndarray:
        """The first place of ``best`` among the values, from 1."""
        at = (self.z == best[:, None]).argmax(1)
        return np.where(self.n > 0, np.cumsum(self.ok, axis=1)[np.arange(len(at)), at], np.nan)

    def quantile(self, ordered: np.ndarray, share: float) -> np.ndarray:
        at = np.maximum(self.n - 1, 0) * share
        lo, hi = np.floor(at).astype(int), np.ceil(at).astype(int)
        a, b = (np.take_along_axis(ordered, k[:, None], 1)[:, 0] for k in (lo, hi))
        return np.where(lo == hi, a, (hi - at) * a + (at - lo) * b)


def _corr(x: _Window, y: _Window) -> np.ndarray:
    """Pearson over at least two pairs; null where either doesn't vary beyond rounding.  Both hold the same places."""
    flat = np.zeros(len(x.n), bool)
    for s in (x, y):
        hi, lo = s.top(), s.bottom()
        flat |= hi - lo <= E * np.maximum(np.abs(hi), np.abs(lo))
    c = (x.off() * y.off()).sum(1) / (x.n - 1) / (x.std() * y.std())
    return np.where(~flat & (x.n >= 2), c, np.nan)


def families(c: np.ndarray, h: np.ndarray, l: np.ndarray, v: np.ndarray, first: np.ndarray, rows: np.ndarray, n: int) -> dict[str, np.ndarray]:  # noqa: E741
    """Each family for ``rows`` of series in order; ``first`` is the row where a row's symbol begins."""
    at = np.arange(len(c))
    back = lambda z, k: np.where(at - k >= first, z[np.maximum(at - k, 0)], np.nan)
    log = lambda z: np.log(np.where(z > 0, z, np.nan))
    idx = rows[:, None] + np.arange(1 - n, 1)
    inside = idx >= first[rows, None]
    idx = np.maximum(idx, 0)
    win = lambda z: _Window(z, idx, inside)
    pc, pv = back(c, 1), back(v, 1)
    rc, rv = c / pc, log(v / pv + 1)
    dc, dv = c - pc, v - pv
    known = ~np.isnan(dc)
    C, V, H, L = win(c), win(v), win(h), win(l)
    top, bottom = H.top(), L.bottom()
    own, vol = c[rows], v[rows]
    # places count from the window's first, which slopes and residuals don't depend on
    x = np.where(C.ok, np.arange(n, dtype=float), np.nan)
    X = _Window.__new__(_Window)
    X.z, X.ok, X.n, X.zero = x, C.ok, C.n, np.where(C.ok, x, 0.0)
    X.sum = X.zero.sum(1)
    X.mean = X.sum / X.n
    xx = (X.off() ** 2).sum(1)
    slope = np.where(xx > 0, (X.off() * C.off()).sum(1) / xx, np.nan)
    ordered = np.sort(C.z, axis=1)
    both = lambda a, b: (win(np.where(np.isnan(b), np.nan, a)), win(np.where(np.isnan(a), np.nan, b)))
    gain, total, vgain, vtotal = (win(z).sum for z in (np.maximum(dc, 0) + 0 * dc, np.abs(dc), np.maximum(dv, 0) + 0 * dv, np.abs(dv)))
    ups, downs = (win(np.where(known, z, np.nan)).mean for z in (dc > 0, dc < 0))
    turn = win(np.abs(rc - 1) * v)
    imax, imin = H.place(top) / n, L.place(bottom) / n
    less, same = (C.z < own[:, None]).sum(1), (C.z == own[:, None]).sum(1)
    return {
        "ROC": back(c, n)[rows] / own, "MA": C.mean / own, "STD": C.std() / own, "BETA": slope / own,
        "RSQR": _corr(C, X) ** 2, "RESI": (own - (C.mean + slope * (n - 1 - X.mean))) / own, "MAX": top / own, "MIN": bottom / own,
        "QTLU": C.quantile(ordered, 0.8) / own, "QTLD": C.quantile(ordered, 0.2) / own,
        "RANK": (less + (same + 1) / 2) / C.n, "RSV": (own - bottom) / (top - bottom + E),
        "IMAX": imax, "IMIN": imin, "IMXD": imax - imin, "CORR": _corr(*both(c, log(v + 1))), "CORD": _corr(*both(rc, rv)),
        "CNTP": ups, "CNTN": downs, "CNTD": ups - downs,
        "SUMP": gain / (total + E), "SUMN": (total - gain) / (total + E), "SUMD": (2 * gain - total) / (total + E),
        "VMA": V.mean / (vol + E), "VSTD": V.std() / (vol + E), "WVMA": turn.std() / (turn.mean + E),
        "VSUMP": vgain / (vtotal + E), "VSUMN": (vtotal - vgain) / (vtotal + E), "VSUMD": (2 * vgain - vtotal) / (vtotal + E),
    }


def rolled(df: DataFrame, symbol: str, date: str, n: int, prefix: str, names: tuple[str, ...]) -> DataFrame:
    """``df`` with the families over the last ``n`` rows of each symbol as columns ``prefix + name``."""
    schema = StructType(list(df.schema.fields))
    for k in names:
        schema = schema.add(prefix + k, DoubleType())
    series = ("close", "high", "low", "volume")

    def run(batches):
        held = None  # the last rows of the symbol at hand: its key, whether that is null, and the series
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(symbol)
            new = [key.to_numpy(zero_copy_only=False), key.is_null().to_numpy(zero_copy_only=False), *(b.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in series)]
            if held is not None:
                new = [np.concatenate([a, z]) for a, z in zip(held, new, strict=True)]
            sym, none, *cols = new
            begins = np.ones(len(sym), bool)
            begins[1:] = ~((sym[1:] == sym[:-1]) | (none[1:] & none[:-1]))
            first = np.maximum.accumulate(np.where(begins, np.arange(len(sym)), 0))
            with np.errstate(all="ignore"):
                out = families(*cols, first, np.arange(len(sym) - b.num_rows, len(sym)), n)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(out[k], pa.float64(), from_pandas=True) for k in names)], names=schema.names)
            held = [z[max(first[-1], len(sym) - n) :] for z in new]

    return df.repartition(symbol).sortWithinPartitions(symbol, date).mapInArrow(run, schema)
