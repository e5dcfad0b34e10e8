"""Cross-sectional operators: each looks at all symbols of one date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.timeseries import EPS, safe_div
from tessera.panel import Panel


def average_rank(x: Column, *by: str | Column) -> Column:
    """Average rank among the rows of a group whose x isn't null (nulls have none)."""
    has = x.isNotNull()
    ties = F.count(x).over(Window.partitionBy(*by, x))
    return F.when(has, F.rank().over(Window.partitionBy(*by, has).orderBy(x)) + (ties - 1) / 2)


def rank(p: Panel, x: Column) -> Column:
    x = p.let(x)
    return p.let(average_rank(x, p.date) / F.count(x).over(p.day()))


def zscore(p: Panel, x: Column) -> Column:
    x = p.let(x)
    return p.let(safe_div(x - F.avg(x).over(p.day()), F.stddev_samp(x).over(p.day())))


def winsorize(p: Panel, x: Column, low: float = 0.01, high: float = 0.99) -> Column:
    """Clipped at linear quantiles of the date."""
    x = p.let(x)
    q = p.let(F.percentile(x, F.array(F.lit(low), F.lit(high))).over(p.day()))
    return p.let(F.when(x.isNotNull(), F.greatest(q[0], F.least(q[1], x))))


def standardize(p: Panel, x: Column) -> Column:
    """(x - mean) / (sd + eps); 0 on a constant date."""
    x = p.let(x)
    m, s = F.avg(x).over(p.day()), F.stddev_samp(x).over(p.day())
    return p.let(F.when(x.isNotNull() & (s <= EPS), 0.0).otherwise((x - m) / (s + EPS)))


def neutralize(p: Panel, x: Column, size: Column | None = None, group: Column | None = None, least: int = 30, keep: bool = True) -> Column:
    """Least-squares residual of x on group dummies and (log) size, exact, without a solver.

    By the Frisch-Waugh-Lovell theorem the residual is that of the demeaned (within
    date and group) x on the demeaned size.  Rows without group or size, and dates with
    fewer than ``least`` complete rows, keep x (or are null without ``keep``).
    """
    x = p.let(x)
    g = p.let(group if group is not None else F.lit("all"))
    ok = x.isNotNull() & g.isNotNull()
    if size is not None:
        size = p.let(size)
        ok = ok & size.isNotNull()
    ok = p.let(ok)
    cell = p.day(g, ok)
    xt = p.let(F.when(ok, x - F.avg(x).over(cell)))
    resid = xt
    if size is not None:
        mt = p.let(F.when(ok, size - F.avg(size).over(cell)))
        den = F.sum(mt * mt).over(p.day())
        beta = p.let(F.when(den > EPS, F.sum(xt * mt).over(p.day()) / den).otherwise(0.0))
        resid = xt - beta * mt
    enough = F.sum(ok.cast("int")).over(p.day()) >= least
    return p.let(F.when(ok & enough, resid).otherwise(x if keep else F.lit(None).cast("double")))


def size_residual(p: Panel, x: Column, size: Column, least: int = 30) -> Column:
    """Residual of x on [1, size]; null on small dates."""
    return neutralize(p, x, size, None, least, keep=False)


def mad_clip(p: Panel, x: Column, k: float = 5.0) -> Column:
    """Clipped at the median +- k median absolute deviations of the date."""
    x = p.let(x)
    mid = p.let(F.percentile(x, F.lit(0.5)).over(p.day()))
    mad = p.let(F.percentile(F.abs(x - mid), F.lit(0.5)).over(p.day()))
    return p.let(F.when(x.isNotNull(), F.greatest(mid - k * mad, F.least(mid + k * mad, x))))


def leave_one_out(p: Panel, x: Column, group: Column, least: int = 5) -> Column:
    """Mean of the others in the group on the date; null in groups under ``least``."""
    x = p.let(x)
    w = p.day(p.let(group))
    n = F.count(x).over(w)
    return p.let(F.when((n >= least) & x.isNotNull(), (F.sum(x).over(w) - x) / (n - 1)))


def bucket(at: Column, n: Column, groups: int) -> Column:
    """Quantile group 0.. of the rank ``at`` (from 1) among n: edges are linear quantiles of 1..n, right-closed."""
    return F.greatest(F.lit(0), F.ceil((at - 1) * groups / (n - 1)).cast("int") - 1)
