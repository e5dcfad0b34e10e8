"""Causal time-series operators: each looks at a symbol's rows up to the current one.

Windows count rows.  A result needs a full window of values that aren't null, so gaps
are never bridged.  Operators take a panel, operands and parameters and return a
Column of the panel.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.panel import Panel, window_size

EPS = 1e-12


def safe_div(a: Column, b: Column, eps: float = EPS) -> Column:
    """a / b; null where either is missing or abs(b) <= eps."""
    return F.when(F.abs(b) > eps, a / b)


def clip(x: Column, low: float, high: float) -> Column:
    if low > high:
        raise ValueError(f"clip from {low} to {high}")
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def log1p(x: Column) -> Column:
    return F.when(x > -1, F.log1p(x))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def where(cond: Column, a: Column, b: Column) -> Column:
    """a or b; null where the condition is null."""
    return F.when(cond, a).when(~cond, b)


def full(p: Panel, x: Column, n: int, value: Column, least: int | None = None) -> Column:
    return F.when(F.count(x).over(p.last(n)) >= (n if least is None else least), value)


def delay(p: Panel, x: Column, n: int = 1) -> Column:
    return p.let(F.lag(p.let(x), window_size(n)).over(p.order()))


def delta(p: Panel, x: Column, n: int = 1) -> Column:
    x = p.let(x)
    return p.let(x - F.lag(x, window_size(n)).over(p.order()))


def pct_change(p: Panel, x: Column, n: int = 1) -> Column:
    x = p.let(x)
    old = p.let(F.lag(x, window_size(n)).over(p.order()))
    return p.let(safe_div(x, old) - 1)


def padded_pct_change(p: Panel, x: Column, n: int = 1) -> Column:
    """The change of the forward-filled series; null on a zero base."""
    filled = p.let(F.last(p.let(x), ignorenulls=True).over(p.sofar()))
    old = p.let(F.lag(filled, window_size(n)).over(p.order()))
    return p.let(F.try_divide(filled, old) - 1)


def rolling(p: Panel, x: Column, n: int, agg, least: int | None = None) -> Column:
    x, n = p.let(x), window_size(n)
    return p.let(full(p, x, n, agg(x).over(p.last(n)), least))


def mean(p, x, n, least=None):
    return rolling(p, x, n, F.avg, least)


def total(p, x, n, least=None):
    return rolling(p, x, n, F.sum, least)


def std(p, x, n, least=None):
    return rolling(p, x, n, F.stddev_samp, least)


def low(p, x, n, least=None):
    return rolling(p, x, n, F.min, least)


def high(p, x, n, least=None):
    return rolling(p, x, n, F.max, least)


def quantile(p, x, n, q, least=None):
    if not 0 <= q <= 1:
        raise ValueError(f"quantile {q}")
    return rolling(p, x, n, lambda c: F.percentile(c, F.lit(float(q))), least)


def median(p, x, n, least=None):
    return quantile(p, x, n, 0.5, least)


def skew(p, x, n, least=None):
    """Bias-adjusted; 0 on a constant window."""
    x, w = p.let(x), p.last(window_size(n))
    k = F.count(x).over(w)
    g = F.skewness(x).over(w) * F.sqrt(k * (k - 1)) / (k - 2)
    return p.let(F.when((k >= (n if least is None else least)) & (k >= 3), F.when(F.max(x).over(w) == F.min(x).over(w), 0.0).otherwise(g)))


def kurt(p, x, n, least=None):
    """Bias-adjusted excess; -3 on a constant window."""
    x, w = p.let(x), p.last(window_size(n))
    k = F.count(x).over(w)
    g = (k - 1) / ((k - 2) * (k - 3)) * ((k + 1) * F.kurtosis(x).over(w) + 6)
    return p.let(F.when((k >= (n if least is None else least)) & (k >= 4), F.when(F.max(x).over(w) == F.min(x).over(w), -3.0).otherwise(g)))


def position(p, x, n):
    """Place between the window's extremes; 0.5 where they are equal."""
    x, w = p.let(x), p.last(window_size(n))
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return p.let(full(p, x, n, F.when(hi == lo, 0.5).otherwise(safe_div(x - lo, hi - lo))))


def rank_pct(p, x, n):
    """Average rank of the last value in its window, as a share."""
    x, w = p.let(x), p.last(window_size(n))
    vals = p.let(F.collect_list(x).over(w))
    less, same = F.size(F.filter(vals, lambda v: v < x)), F.size(F.filter(vals, lambda v: v == x))
    return p.let(F.when(F.size(vals) == n, (less + (same + 1) / 2) / n))


def _pairs(p: Panel, x: Column, y: Column) -> tuple[Column, Column]:
    x, y = p.let(x), p.let(y)
    return p.let(F.when(y.isNotNull(), x)), p.let(F.when(x.isNotNull(), y))


def cov(p, x, y, n):
    x, y = _pairs(p, x, y)
    return p.let(full(p, x, window_size(n), F.covar_samp(x, y).over(p.last(n))))


def corr(p, x, y, n, least=None):
    """Pearson over complete pairs; null where either doesn't vary (beyond rounding)."""
    x, y = _pairs(p, x, y)
    w = p.last(window_size(n))

    def constant(z):
        hi, lo = F.max(z).over(w), F.min(z).over(w)
        return hi - lo <= EPS * F.greatest(F.abs(hi), F.abs(lo))

    flat = constant(x) | constant(y)
    c = F.try_divide(F.covar_samp(x, y).over(w), F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w))
    return p.let(F.when(~flat, full(p, x, n, c, least)))


def rsquare(p, x, y, n):
    c = corr(p, x, y, n)
    return p.let(c * c)


def mad(p, x, n):
    """Mean absolute deviation from the window's mean."""
    x, w = p.let(x), p.last(window_size(n))
    vals, m = p.let(F.collect_list(x).over(w)), p.let(F.avg(x).over(w))
    return p.let(F.when(F.size(vals) == n, F.aggregate(vals, F.lit(0.0), lambda a, v: a + F.abs(v - m)) / n))


def slope(p, x, n):
    """Least-squares slope over the row number."""
    x = p.let(x)
    at = p.let(F.row_number().over(p.order()).cast("double"))
    return p.let(full(p, x, window_size(n), F.regr_slope(x, at).over(p.last(n))))


def decay_linear(p, x, n):
    """Weights 1..n, the newest heaviest, in closed form."""
    x, w = p.let(x), p.last(window_size(n))
    at = p.let(F.row_number().over(p.order()).cast("double"))
    ax = p.let(at * x)
    return p.let(full(p, x, n, (F.sum(ax).over(w) - (at - n) * F.sum(x).over(w)) / (n * (n + 1) / 2)))


def fold_length(alpha: float, tolerance: float = 1e-13) -> int:
    return max(2, math.ceil(math.log(tolerance) / math.log(1 - alpha)))


def _ewm(p: Panel, x: Column, alpha: float, *keys: Column) -> Column:
    """y = a x + (1 - a) y from a series' first value, as sums over blocks of rows.

    Inside a block, values are weighed up by at most 1000 and their running sum is weighed
    down; blocks before it add theirs while their weight exceeds 1e-13.  No row holds more
    than numbers.
    """
    series = Window.partitionBy(p.symbol, *keys)
    sofar = series.orderBy(p.date).rowsBetween(Window.unboundedPreceding, 0)
    if alpha >= 1:
        return p.let(F.last(x, ignorenulls=True).over(sofar))
    keep = 1 - alpha
    size = fold_length(alpha, 1e-3)
    at = p.let(F.count(x).over(sofar) - 1)
    block = p.let(F.floor(at / size))
    place = p.let(F.pow(F.lit(keep), (at - block * size).cast("double")))
    up = p.let(F.when(at == 0, x).otherwise(x * alpha) / place)
    own = p.let(F.sum(up).over(Window.partitionBy(p.symbol, *keys, block).orderBy(p.date).rowsBetween(Window.unboundedPreceding, 0)))
    blocks = math.ceil(fold_length(alpha) / size)
    before = [F.coalesce(F.sum(up).over(series.orderBy(block).rangeBetween(-k, -k)), F.lit(0.0)) * keep ** (k * size) for k in range(1, blocks + 1)]
    return p.let(F.when(at >= 0, place * (F.coalesce(own, F.lit(0.0)) + sum(before, F.lit(0.0)))))


def ewm_mean(p, x, span: int):
    """Exponential mean with a = 2 / (span + 1); starts afresh after a gap and needs ``span`` values."""
    x, alpha = p.let(x), 2 / (window_size(span) + 1)
    part = p.let(F.sum(x.isNull().cast("int")).over(p.sofar()))
    w = Window.partitionBy(p.symbol, part).orderBy(p.date)
    run = p.let(F.count(x).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    y = _ewm(p, x, alpha, part)
    return p.let(F.when(x.isNotNull() & (run >= span), y))


def ewm_plain(p, x, alpha: float):
    """Exponential mean from the first value on, without warm-up, for series without gaps."""
    return _ewm(p, p.let(x), alpha)


def count(p, cond, n):
    """True rows in a full window of conditions that aren't null."""
    c = p.let(cond.cast("int"))
    return p.let(full(p, c, window_size(n), F.sum(c).over(p.last(n))))


def consecutive_count(p, cond, n):
    """Length of the run of true rows that ends here, at most n; needs a full window."""
    c = p.let(cond.cast("int"))
    at = p.let(F.row_number().over(p.order()))
    stop = p.let(F.last(F.when(c == 0, at), ignorenulls=True).over(p.sofar()))
    return p.let(full(p, c, window_size(n), F.least(F.lit(n), at - F.coalesce(stop, F.lit(0)))))


def path_drawdown(p, x, n):
    """Largest fall from a peak to a later trough inside a full window, as a positive share."""
    x = p.let(x)
    vals = p.let(F.collect_list(x).over(p.last(window_size(n))))
    start = F.struct(F.element_at(vals, 1).alias("peak"), F.lit(0.0).alias("fall"))

    def step(s, v):
        peak = F.greatest(s["peak"], v)
        return F.struct(peak.alias("peak"), F.greatest(s["fall"], 1 - v / peak).alias("fall"))

    return p.let(F.when(F.size(vals) == n, F.aggregate(vals, start, step)["fall"]))
