"""Evaluation of factors, signals and portfolios as relations: one pass of windows and aggregates each.

Long tables have (date, factor, x, y); rows where x or y is null count as missing.
"""

from __future__ import annotations

from datetime import date as Date

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import crosssection as cs
from tessera.operators.statistics import EPS, correlation, ic_summary
from tessera.panel import Panel

C = F.col


def decile_monotonicity(long: DataFrame) -> DataFrame:
    """Mean label of ten groups of equal **width** in the rank share of each date, D1 the lowest.

    Dates on which a factor misses more than half of its values are left out; each date
    weighs the same.  ``long_short`` is the mean of D1 - D10 over dates that have both;
    ``monotonic``: D1 > D10 and at least 60 % of neighbours fall.
    """
    day = Window.partitionBy("date", "factor")
    d = long.withColumn("k", cs.average_rank(C("x"), "date", "factor"))
    d = d.withColumns({"n": F.count("*").over(day), "has": F.count("x").over(day), "lo": F.min("k").over(day), "hi": F.max("k").over(day)})
    d = d.where("x IS NOT NULL AND 2 * (n - has) <= n")
    grp = F.when(C("hi") == C("lo"), 5).otherwise(F.greatest(F.lit(1), F.ceil((C("k") - C("lo")) * 10 / (C("hi") - C("lo")))))
    by = d.groupBy("factor", "date").agg(*[F.avg(F.when(grp == g, C("y"))).alias(f"d{g}") for g in range(1, 11)])
    out = by.groupBy("factor").agg(*[F.avg(f"d{g}").alias(f"d{g}") for g in range(1, 11)], F.avg(C("d1") - C("d10")).alias("long_short"))
    falls = sum((F.coalesce(C(f"d{g + 1}") < C(f"d{g}"), F.lit(False)).cast("int") for g in range(1, 10)), F.lit(0))
    return out.withColumn("monotonic", F.coalesce((C("d1") > C("d10")) & (falls >= 0.6 * 9), F.lit(False)))


def value_redundancy(df: DataFrame, factors: list[str], least: int = 30) -> DataFrame:
    """Mean daily rank correlation of the values of each pair of factors, plain and absolute.

    Dates with fewer than ``least`` complete rows, or with one value only, are left out.
    """
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    p = df.select("date", F.inline(F.array(*[F.struct(F.lit(a).alias("factor"), F.lit(b).alias("other"), C(a).alias("x"), C(b).alias("z")) for a, b in pairs])))
    p = p.where("x IS NOT NULL AND z IS NOT NULL")
    by = ["date", "factor", "other"]
    p = p.withColumns({"rx": cs.average_rank(C("x"), *by), "rz": cs.average_rank(C("z"), *by)})
    day = p.groupBy(*by).agg(F.count("*").alias("n"), correlation("rx", "rz").alias("c")).where((C("n") >= least) & C("c").isNotNull())
    return day.groupBy("factor", "other").agg(F.avg("c").alias("corr"), F.avg(F.abs("c")).alias("abs_corr"), F.count("*").alias("days"))


def retention(raw: DataFrame, neutral: DataFrame) -> DataFrame:
    """Rank IC of factors before and after neutralising: both summaries, the change and the share retained."""
    a = ic_summary(raw).select("factor", C("mean").alias("raw"), C("icir").alias("raw_icir"), C("days").alias("raw_days"))
    b = ic_summary(neutral).select("factor", C("mean").alias("neutral"), C("icir").alias("neutral_icir"), C("days").alias("neutral_days"))
    return a.join(b, "factor", "left").withColumns({"change": C("neutral") - C("raw"), "retention": F.try_divide("neutral", F.nullif("raw", F.lit(0.0)))})


def annualised(ics: DataFrame, periods: int = 252) -> DataFrame:
    """Means, deviations and information ratios times the root of ``periods``, of IC and rank IC."""
    of = lambda c, k: [F.avg(c).alias(f"{k}_mean"), F.stddev_samp(c).alias(f"{k}_std"), (F.avg(c) / (F.stddev_samp(c) + EPS) * periods**0.5).alias(f"{k}_ir")]
    return ics.groupBy("factor").agg(*of("ic", "ic"), *of("rank_ic", "rank_ic"), F.avg((C("ic") > 0).cast("double")).alias("positive"), F.count("*").alias("days"))


def funnel(summary: DataFrame, mean: float = 0.01, icir: float = 0.05) -> DataFrame:
    """Adds ``kept``: the mean reaches its bound and the information ratio exceeds its own, in absolute value."""
    return summary.withColumn("kept", F.coalesce((F.abs("mean") >= mean) & (F.abs("icir") > icir), F.lit(False)))


def overlap(members: DataFrame, by: list[str]) -> DataFrame:
    """``by, t, n, was, both``: sizes of sets at step t and the one before, and of what they share.

    ``members`` is (by, t, symbol), t a whole number without gaps; a join on (by, symbol, t),
    so no task holds all sets.
    """
    before = members.withColumn("t", C("t") + 1)
    both = members.join(before, [*by, "symbol", "t"]).groupBy(*by, "t").agg(F.count("*").alias("both"))
    size = members.groupBy(*by, "t").agg(F.count("*").alias("n"))
    was = size.select(*by, (C("t") + 1).alias("t"), C("n").alias("was"))
    return size.join(was, [*by, "t"], "left").join(both, [*by, "t"], "left").withColumn("both", F.when(C("was").isNotNull(), F.coalesce("both", F.lit(0))))


def tradability(df: DataFrame, score: str, least: int = 100, share: float = 0.1) -> DataFrame:
    """A row a date: turnover of the long (low) and short (high) tails, and shares of their rows that can't trade.

    ``df``: date, symbol, score, volume and limit flags up, lock_up, down, lock_down.
    Dates with fewer than ``least`` scores are left out.
    """
    day = Window.partitionBy("date")
    d = df.where(C(score).isNotNull()).withColumn("n", F.count("*").over(day)).where(C("n") >= least)
    d = d.withColumn("q", F.percentile(score, F.array(F.lit(share), F.lit(1 - share))).over(day))
    d = d.withColumn("side", F.array_compact(F.array(F.when(C(score) <= C("q")[0], "long"), F.when(C(score) >= C("q")[1], "short"))))
    d = d.withColumn("side", F.explode("side"))
    dates = d.select("date").distinct().withColumn("t", F.row_number().over(Window.orderBy("date")))  # a calendar
    turn = overlap(d.join(F.broadcast(dates), "date").select("side", "symbol", "t"), ["side"])
    turn = turn.groupBy("t").agg((F.sum(1 - C("both") / C("n")) * 0.5).alias("turnover"))
    rate = lambda side, flag: F.avg(F.when(C("side") == side, F.coalesce(flag, F.lit(False)).cast("double")))
    still = F.coalesce("volume", F.lit(0.0)) <= 0
    out = d.groupBy("date").agg(
        rate("long", C("up")).alias("long_limit_up"), rate("long", C("lock_up")).alias("long_lock_up"), rate("short", C("down")).alias("short_limit_down"),
        rate("short", C("lock_down")).alias("short_lock_down"), rate("long", still).alias("long_suspended"), rate("short", still).alias("short_suspended"),
    )
    return out.join(dates, "date").join(turn, "t", "left").drop("t")


def tradability_summary(daily: DataFrame, period: Column, bps: tuple[int, ...] = (10, 20, 30)) -> DataFrame:
    """Means of ``tradability`` by period, the yearly turnover and its cost at some rates."""
    cols = [c for c in daily.columns if c != "date"]
    out = daily.groupBy(period.alias("period")).agg(F.count("*").alias("days"), *[F.avg(c).alias(c) for c in cols])
    return out.withColumns({"annual_turnover": C("turnover") * 252, **{f"cost_{b}_bps": C("turnover") * 252 * b / 10_000 for b in bps}})


def signal_diagnosis(df: DataFrame, k: int, least: int) -> DataFrame:
    """Raw against neutralised signal on each date: rank ICs, returns of the k best by label and by fills, their overlap.

    ``df``: date, symbol, pred, alpha, label, fill (open to open return).
    """
    d = df.where("pred IS NOT NULL AND alpha IS NOT NULL AND label IS NOT NULL").withColumn("n", F.count("*").over(Window.partitionBy("date"))).where(C("n") >= max(least, 2 * k))
    d = d.withColumns({f"r_{c}": cs.average_rank(C(c), "date") for c in ("pred", "alpha", "label")})
    top = lambda c: F.row_number().over(Window.partitionBy("date").orderBy(F.desc(c), "symbol")) <= k
    d = d.withColumns({"by_pred": top("pred"), "by_alpha": top("alpha")})
    of = lambda m, c: F.avg(F.when(C(m), C(c)))
    return d.groupBy("date").agg(
        F.count("*").alias("n"), correlation("r_pred", "r_label").alias("raw_rank_ic"), correlation("r_alpha", "r_label").alias("neutral_rank_ic"),
        of("by_pred", "label").alias("raw_return"), of("by_alpha", "label").alias("neutral_return"), of("by_pred", "fill").alias("raw_fill"),
        of("by_alpha", "fill").alias("neutral_fill"), correlation(F.when(C("fill").isNotNull(), C("label")), "fill").alias("label_fill"), (F.sum((C("by_pred") & C("by_alpha")).cast("int")) / k).alias("overlap"),
    )


#: Daily price limits by board, and the day on which the growth board's rose.
BOARDS = {"SH68": 0.2, "SZ30": 0.2, "BJ": 0.3}
REFORM = Date(2020, 8, 24)


def board_limit(code: Column, date: Column, reform: Date = REFORM) -> Column:
    """Daily price limit of a prefixed code (``SH600000``) on a date."""
    return (
        F.when(code.startswith("SH68"), BOARDS["SH68"]).when(code.startswith("SZ30") & (date >= F.lit(reform)), BOARDS["SZ30"])
        .when(code.startswith("BJ"), BOARDS["BJ"]).otherwise(0.1)
    )


def official_limits(change: Column, limit: Column, slack: float = 0.5) -> tuple[Column, Column]:
    """Limit-up and limit-down flags from an official change in per cent; a missing change sets neither."""
    reach = limit * 100 - slack
    return F.coalesce(change >= reach, F.lit(False)), F.coalesce(change <= -reach, F.lit(False))


def neutralize_controls(p: Panel, x: Column, group: Column, controls: list[Column], least: int = 50, clip: float = 5.0) -> Column:
    """Residual of the MAD-clipped x on group dummies and several controls, standardised; null on small dates.

    Frisch-Waugh-Lovell once a control: everything is demeaned within (date, group), then
    each control in turn is taken out of those after it and of x.
    """
    x, g, cols = p.let(x), p.let(group), [p.let(c) for c in controls]
    ok = x.isNotNull() & g.isNotNull()
    for c in cols:
        ok = ok & c.isNotNull()
    ok = p.let(ok)
    y = cs.mad_clip(p, p.let(F.when(ok, x)), clip)
    cell = p.day(g, ok)
    rest = [p.let(F.when(ok, c - F.avg(c).over(cell))) for c in [*cols, y]]
    for k in range(len(cols)):
        base, den = rest[k], F.sum(rest[k] * rest[k]).over(p.day())
        den = p.let(den)
        for j in range(k + 1, len(rest)):
            beta = p.let(F.when(den > 1e-9, F.sum(rest[j] * base).over(p.day()) / den).otherwise(0.0))
            rest[j] = p.let(rest[j] - beta * base)
    e = rest[-1]
    n = F.sum(ok.cast("int")).over(p.day())
    sd = F.stddev_samp(e).over(p.day())
    return p.let(F.when(ok & (n >= least), (e - F.avg(e).over(p.day())) / (sd + EPS)))


def portfolio_metrics(nav: DataFrame, by: str, order: str, periods: float = 252.0) -> DataFrame:
    """Performance of each series against its benchmark, with turnover and costs.

    ``nav``: by, order, nav, benchmark, turnover, cost, blocked_buy, blocked_sell, selected.
    The first rebalance (the first turnover above 0) is no turnover.
    """
    w = Window.partitionBy(by).orderBy(order)
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    x = nav.withColumns({
        "ret": C("nav") / F.lag("nav").over(w) - 1, "bret": C("benchmark") / F.lag("benchmark").over(w) - 1, "peak": F.max("nav").over(sofar),
        "builds": F.sum((C("turnover") > 0).cast("int")).over(sofar), "held": F.coalesce(F.lag("nav").over(w), C("nav")),
    }).withColumn("kept_turnover", F.when((C("turnover") > 0) & (C("builds") == 1), None).otherwise(C("turnover")))
    n = F.count("ret")
    years = F.greatest(n / periods, F.lit(1 / periods))
    growth = lambda c: F.pow(F.max_by(c, order) / F.min_by(c, order), 1 / years) - 1
    ex = C("ret") - C("bret")
    ratio = lambda a: F.avg(a) / (F.stddev_samp(a) + EPS) * periods**0.5
    worst = F.min(C("nav") / C("peak") - 1)
    return x.groupBy(by).agg(
        n.alias("periods"), growth("nav").alias("annual_return"), growth("benchmark").alias("benchmark_annual_return"), (growth("nav") - growth("benchmark")).alias("annual_excess_return"),
        (F.stddev_samp("ret") * periods**0.5).alias("annual_volatility"), ratio(C("ret")).alias("sharpe"), ratio(ex).alias("information_ratio"), (F.stddev_samp(ex) * periods**0.5).alias("tracking_error"),
        worst.alias("max_drawdown"), F.try_divide(growth("nav"), F.nullif(F.abs(worst), F.lit(0.0))).alias("calmar"), F.max_by("nav", order).alias("final_nav"),
        F.avg(F.when(C("ret").isNotNull(), (C("ret") > 0).cast("double"))).alias("win_rate"), F.max("ret").alias("best"), F.min("ret").alias("worst"),
        F.avg("kept_turnover").alias("average_turnover"), (F.sum("kept_turnover") / years).alias("annual_turnover"), F.sum("cost").alias("total_cost"), F.avg(C("cost") / C("held")).alias("cost_ratio"),
        F.sum("blocked_buy").alias("blocked_buy"), F.sum("blocked_sell").alias("blocked_sell"), (F.sum("blocked_buy") / F.greatest(F.sum("selected"), F.lit(1))).alias("blocked_buy_rate"),
    )


def preset_score(metrics: DataFrame) -> DataFrame:
    """Adds ``preset_score``: risk-adjusted return less penalties for falls, volatility and turnover."""
    return metrics.withColumn("preset_score", C("sharpe") + 0.5 * C("information_ratio") + 0.75 * C("annual_excess_return") - 0.75 * F.abs("max_drawdown") - 0.2 * C("annual_volatility") - 2.0 * C("average_turnover"))


def trial_memory(trials: DataFrame) -> DataFrame:
    """By category: trials, passes, the best absolute rank IC, mean turnover, and whether it is open, closed or probed.

    ``trials``: category, passed (boolean), rank_ic, turnover.
    """
    g = trials.groupBy("category").agg(
        F.count("*").alias("trials"), F.sum(C("passed").cast("int")).alias("passed"), F.coalesce(F.max(F.abs("rank_ic")), F.lit(0.0)).alias("best"), F.avg("turnover").alias("turnover"),
    )
    status = F.when(C("passed") > 0, "open").when((C("trials") >= 3) & (C("best") < 0.02), "closed_sterile").otherwise("probing")
    return g.withColumn("status", status)


#: Fixed value: the day on which the newer taxonomy begins.
TAXONOMY = Date(2021, 12, 13)


def industry_intervals(old: DataFrame, new: DataFrame, start: Date = TAXONOMY) -> DataFrame:
    """Membership intervals [start_date, end_date) of two taxonomies, the older one up to ``start``, the newer from it.

    Both have symbol, industry, start_date, end_date (null: open).  Rows without a symbol,
    industry or start, and intervals that end before they begin, are void; a row whose
    interval overlaps the one before has ``overlaps``.
    """
    day = F.lit(start)
    a = old.withColumn("version", F.lit("old")).withColumn("end_", F.least(F.coalesce("end_date", day), day)).withColumn("start_", C("start_date"))
    b = new.withColumn("version", F.lit("new")).withColumn("end_", C("end_date")).withColumn("start_", F.greatest("start_date", day))
    both = a.unionByName(b).where("symbol IS NOT NULL AND industry IS NOT NULL AND start_date IS NOT NULL AND (end_date IS NULL OR end_date > start_date)")
    both = both.where("end_ IS NULL OR start_ < end_").select("symbol", "industry", C("start_").alias("start_date"), C("end_").alias("end_date"), "version").distinct()
    w = Window.partitionBy("symbol").orderBy("start_date", "industry", "version")
    first = F.row_number().over(w) == 1
    open_end = F.coalesce(F.lag("end_date").over(w), F.lit(Date(9999, 12, 31)))
    return both.withColumn("overlaps", ~first & (C("start_date") < open_end))


def mean_variance(alpha: np.ndarray, covariance: np.ndarray, before: np.ndarray, industry: np.ndarray, exposure: float = 1.0, risk: float = 8.0, penalty: float = 0.02, most: float = 0.05, industry_most: float = 0.3, turnover: float | None = None, rounds: int = 4000) -> np.ndarray:
    """Weights that maximise alpha - risk x variance - penalty x |w - before|, long only, within caps; sum ``exposure``.

    Some tens of names: proximal steps, each followed by Dykstra's projections onto the
    caps, the sum, the industries and (where it can be met) the bound on turnover.
    """
    n = len(alpha)
    groups = [np.flatnonzero(industry == g) for g in np.unique(industry)]
    most = max(most, exposure / n)
    room = industry_most if sum(min(industry_most, most * len(g)) for g in groups) >= exposure - 1e-12 else 1.0

    def ball(v, bound):
        d = v - before
        if np.abs(d).sum() <= bound:
            return v
        u = np.sort(np.abs(d))[::-1]
        c = (np.cumsum(u) - bound) / np.arange(1, n + 1)
        t = c[np.flatnonzero(u > c)[-1]]
        return before + np.sign(d) * np.maximum(np.abs(d) - t, 0)

    def cap(v):
        v = v.copy()
        for g in groups:
            over = v[g].sum() - room
            if over > 0:
                v[g] -= over / len(g)
        return v

    sets = [lambda v: np.clip(v, 0, most), lambda v: v + (exposure - v.sum()) / n, cap]

    def project(v, sets):
        kept = [np.zeros(n) for _ in sets]
        for _ in range(200):
            start = v
            for k, s in enumerate(sets):
                u = s(v + kept[k])
                kept[k] = v + kept[k] - u
                v = u
            if np.abs(v - start).max() < 1e-10:
                break
        return v

    if turnover is not None and before.sum() > 0:
        tight = [*sets, lambda v: ball(v, turnover)]
        if np.abs(project(before, tight) - before).sum() <= turnover + 1e-6:
            sets = tight
    w = project(np.full(n, exposure / n), sets)
    step = 1 / (2 * risk * np.linalg.eigvalsh(covariance).max() + 1.0)
    best, top = w, -np.inf
    for _ in range(rounds):
        v = w + step * (alpha - 2 * risk * covariance @ w)
        d = v - before
        v = before + np.sign(d) * np.maximum(np.abs(d) - step * penalty, 0)
        new = project(v, sets)
        value = alpha @ new - risk * new @ covariance @ new - penalty * np.abs(new - before).sum()
        if value > top:
            best, top = new, value
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    out = np.maximum(best, 0)
    return out * exposure / max(out.sum(), EPS)
