"""Information coefficients, quantile groups, redundancy and tests of significance.

Values are long: (date, factor, x, y).  Ranks are average ranks on complete pairs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.crosssection import average_rank, bucket

EPS = 1e-12


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson as an aggregate; null where a side doesn't vary (no error under ANSI)."""
    return F.try_divide(F.covar_samp(x, y), F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0)))


def unpivot(df: DataFrame, keys: list[str], columns: list[str], keep: list[str]) -> DataFrame:
    """Factors as rows: keys, kept columns, ``factor``, ``x``."""
    return df.unpivot([*keys, *keep], columns, "factor", "x")


def daily_ic(long: DataFrame, least: int = 5) -> DataFrame:
    """``ic`` and ``rank_ic`` a (date, factor) with at least ``least`` complete pairs."""
    ok = long.where("x IS NOT NULL AND y IS NOT NULL")
    by = ["date", "factor"]
    ranked = ok.withColumn("rx", average_rank(F.col("x"), *by)).withColumn("ry", average_rank(F.col("y"), *by))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), correlation("x", "y").alias("ic"), correlation("rx", "ry").alias("rank_ic")).where(F.col("n") >= least)


def student_t_sf(t: float, df: float) -> float:
    """Two-sided tail probability of Student's t, by the incomplete beta function's continued fraction."""
    if df <= 0 or math.isnan(t):
        return float("nan")
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0
    swap = x > (a + 1) / (a + b + 2)
    aa, bb, xx = (b, a, 1 - x) if swap else (a, b, x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + aa * math.log(xx) + bb * math.log(1 - xx)) / aa
    c, d = 1.0, 1 / (1 - (aa + bb) * xx / (aa + 1) or 1e-300)
    f = d
    for m in range(1, 300):
        for num in (m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m)), -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return 1 - front * f if swap else front * f


def ic_summary(ics: DataFrame, value: str = "rank_ic") -> DataFrame:
    """Mean, deviation, count, information ratio and t of each factor's daily values."""
    m, s, n = F.avg(value), F.stddev_samp(value), F.count(value)
    return ics.groupBy("factor").agg(m.alias("mean"), s.alias("std"), n.alias("days"), (m / (s + EPS)).alias("icir"), (m / (s / F.sqrt(n))).alias("t"))


def with_p_values(summary: DataFrame) -> DataFrame:
    """Adds the two-sided p of t with days - 1 degrees; one row a factor, in batches."""
    def run(batches):
        for pdf in batches:
            yield pdf.assign(p=[student_t_sf(t, n - 1) for t, n in zip(pdf["t"], pdf["days"], strict=True)])

    return summary.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in [*summary.dtypes, ("p", "double")]))


def benjamini_hochberg(df: DataFrame, p: str, key: str) -> DataFrame:
    """Adds ``q``: running minimum from the largest p of p * m / rank.  One row a hypothesis."""
    w = Window.orderBy(F.col(p), F.col(key))
    m = F.count("*").over(Window.partitionBy())
    raw = df.withColumn("_r", F.row_number().over(w)).withColumn("_q", F.col(p) * m / F.col("_r"))
    back = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("q", F.least(F.min("_q").over(back), F.lit(1.0))).drop("_r", "_q")


def newey_west(series: DataFrame, value: str, order: str, by: str, lags: int) -> DataFrame:
    """Mean, its HAC error (Bartlett weights) and t of each series."""
    w = Window.partitionBy(by).orderBy(order)
    d = series.where(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.avg(value).over(Window.partitionBy(by)))
    cols = [F.sum(F.col("_d") * F.col("_d")).alias("_g0")]
    for k in range(1, lags + 1):
        d = d.withColumn(f"_l{k}", F.lag("_d", k).over(w))
        cols.append(F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_g{k}"))
    out = d.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), *cols)
    use = F.least(F.lit(lags), F.col("n") - 2)
    total = F.col("_g0")
    for k in range(1, lags + 1):
        total = total + F.when(F.lit(k) <= use, 2 * (1 - k / (use + 1)) * F.coalesce(F.col(f"_g{k}"), F.lit(0.0))).otherwise(0.0)
    se = F.sqrt(F.greatest(total, F.lit(0.0))) / F.col("n")
    return out.select(by, "n", "mean", se.alias("se"), F.try_divide(F.col("mean"), F.nullif(se, F.lit(0.0))).alias("t"))


def quantile_groups(df: DataFrame, x: str, groups: int, least: int = 1) -> DataFrame:
    """Adds ``grp`` 0.. by rank of x on its date; ties go by symbol."""
    ok = df.where(F.col(x).isNotNull())
    n = F.count("*").over(Window.partitionBy("date"))
    k = F.row_number().over(Window.partitionBy("date").orderBy(x, "symbol"))
    return ok.withColumn("_n", n).withColumn("_k", k).where(F.col("_n") >= least).withColumn("grp", bucket(F.col("_k"), F.col("_n"), groups)).drop("_n", "_k")


def greedy_prune(names: list[str], score: dict[str, float], corr: dict[tuple[str, str], float], limit: float = 0.7, absolute: bool = False) -> list[tuple[str, bool, str | None, float | None]]:
    """In the order of falling score, a factor stays unless it correlates above ``limit`` with one that stayed.

    Gives (factor, kept, best match, its correlation).  Some hundred factors: a loop on the driver.
    """
    kept: list[str] = []
    out = []
    for f in sorted(names, key=lambda f: (-(abs(score[f]) if absolute else score[f]), f)):
        seen = [(abs(c) if absolute else c, k) for k in kept if (c := corr.get((f, k), corr.get((k, f)))) is not None]
        top = max(seen, key=lambda t: (t[0], t[1]), default=None)
        ok = top is None or top[0] <= limit
        if ok:
            kept.append(f)
        out.append((f, ok, top[1] if top else None, float(top[0]) if top else None))
    return out


def effective_dimension(corr: np.ndarray) -> float:
    """Participation ratio of a correlation matrix: (tr C)^2 / |C|^2."""
    return float(np.trace(corr) ** 2 / (corr**2).sum())


def value_runs(df: DataFrame, x: str, by: list[str], ranges: int = 200) -> DataFrame:
    """``by, x, c, before, n``: distinct values with their counts, the rows of smaller values and all rows of a group.

    Counts are summed in order inside ranges of values whose edges are approximate
    quantiles (``ranges`` numbers a group), so no task holds a group's values.  Nulls are
    left out; an empty table gives no rows.
    """
    names = by
    by = by or ["_all"]
    v = df.withColumn("_all", F.lit(0)).where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("c"))
    edges = v.groupBy(*by).agg(F.percentile_approx(x, [k / ranges for k in range(1, ranges)], 20 * ranges).alias("_e"))
    v = v.join(edges, by)
    v = v.withColumn("_p", F.size(F.filter("_e", lambda e: e < F.col(x)))).drop("_e")
    w = Window.partitionBy(*by).orderBy("_p")
    sums = v.groupBy(*by, "_p").agg(F.sum("c").alias("_s"))
    sums = sums.withColumns({"_b": F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s"), "n": F.sum("_s").over(Window.partitionBy(*by))})
    inside = Window.partitionBy(*by, "_p").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    v = v.join(sums, [*by, "_p"])
    return v.select(*names, x, "c", (F.col("_b") + F.sum("c").over(inside) - F.col("c")).alias("before"), "n")


def exact_quantiles(df: DataFrame, x: str, by: list[str], shares: tuple[float, ...]) -> DataFrame:
    """``by, n, q``: exact linear quantiles of each group, as an array in the order of ``shares``."""
    runs = value_runs(df, x, by)
    at = [F.lit(s) * (F.col("n") - 1) for s in shares]
    # a run holds the places before .. before + c - 1; each quantile needs the values at two
    pick = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("c")), F.col(x)))
    cols = [c for k, a in enumerate(at) for c in (pick(F.floor(a)).alias(f"_l{k}"), pick(F.ceil(a)).alias(f"_h{k}"))]
    out = runs.groupBy(*by).agg(F.first("n").alias("n"), *cols)
    part = [F.lit(s) * (F.col("n") - 1) - F.floor(F.lit(s) * (F.col("n") - 1)) for s in shares]
    return out.select(*by, "n", F.array(*[F.col(f"_l{k}") + p * (F.col(f"_h{k}") - F.col(f"_l{k}")) for k, p in enumerate(part)]).alias("q"))


def narrowed_quantiles(df: DataFrame, x: str, by: str, shares: tuple[float, ...], slack: float = 1e-3) -> dict[object, tuple[int, list[float]]]:
    """Exact linear quantiles: n and the quantiles of each group, on the driver; nulls are left out.

    A mergeable sketch gives a bracket of ``slack`` ranks on either side of each share; rows
    below a bracket are counted, and only those inside are sorted.  Where a place is outside
    its bracket after all, brackets widen until they hold every row.  Reads ``df`` three times;
    no task holds a group's values.
    """
    spark, ok = df.sparkSession, df.where(F.col(x).isNotNull()).select(by, x)
    key, k_of = F.col(by), range(len(shares))
    while True:
        ends = [[max(0.0, s - slack) for s in shares], [min(1.0, s + slack) for s in shares]]
        sketch = [F.percentile_approx(x, e, int(min(100_000, max(10_000, 10 / slack)))) for e in ends]
        got = ok.groupBy(by).agg(F.count("*").alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), sketch[0].alias("lo"), sketch[1].alias("hi")).collect()
        if not got:
            return {}
        n = {g[by]: g.n for g in got}
        rows = [(g[by], [g.least if e <= 0 else v for e, v in zip(ends[0], g.lo, strict=True)], [g.most if e >= 1 else v for e, v in zip(ends[1], g.hi, strict=True)]) for g in got]
        kind = dict(df.dtypes)[by]
        near = ok.join(F.broadcast(spark.createDataFrame(rows, f"`{by}` {kind}, _lo array<double>, _hi array<double>")), by)
        below = {g[by]: g[1:] for g in near.groupBy(by).agg(*[F.sum((F.col(x) < F.col("_lo")[k]).cast("long")) for k in k_of]).collect()}
        inside = [(F.col(x) >= F.col("_lo")[k]) & (F.col(x) <= F.col("_hi")[k]) for k in k_of]
        some = inside[0]
        for c in inside[1:]:
            some = some | c
        held = near.where(some).select(by, x, F.explode(F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(inside)])).alias("_k")).where("_k IS NOT NULL")
        runs = held.groupBy(by, "_k", x).agg(F.count("*").alias("_c"))
        place = [(g, k, below[g][k], shares[k] * (n[g] - 1)) for g in n for k in k_of]
        runs = runs.join(F.broadcast(spark.createDataFrame(place, f"`{by}` {kind}, _k int, _b long, _at double")), [by, "_k"])
        up_to = F.col("_b") + F.sum("_c").over(Window.partitionBy(by, "_k").orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
        runs = runs.withColumn("_to", up_to)
        pick = lambda p: F.max(F.when((F.col("_to") - F.col("_c") <= p) & (p < F.col("_to")), F.col(x)))
        found = {(g[by], g._k): (g.l, g.h) for g in runs.groupBy(key, "_k").agg(pick(F.floor("_at")).alias("l"), pick(F.ceil("_at")).alias("h")).collect()}
        if all(None not in found.get((g, k), (None,)) for g, k, *_ in place):
            part = {(g, k): at - math.floor(at) for g, k, _, at in place}
            return {g: (n[g], [found[g, k][0] + part[g, k] * (found[g, k][1] - found[g, k][0]) for k in k_of]) for g in n}
        slack *= 10
