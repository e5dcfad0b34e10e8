"""Schedules, tradability, selection, simulators and performance."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def week_schedule(days: DataFrame) -> DataFrame:
    """(signal, execution): the last trading day of each ISO week and the next trading day; ``days`` is a calendar."""
    d = days.select("date").distinct().withColumn("next", F.lead("date").over(Window.orderBy("date")))
    week = [F.extract(F.lit(k), "date") for k in ("YEAROFWEEK", "WEEK")]
    return d.groupBy(week[0].alias("y"), week[1].alias("w")).agg(F.max(F.struct("date", "next")).alias("m")).select(F.col("m.date").alias("signal"), F.col("m.next").alias("execution")).where("execution IS NOT NULL")


def limit_rate(symbol: Column) -> Column:
    """Daily price limit by board (here: the symbol's last digit)."""
    board = symbol % 10
    return F.when(board == 0, 0.3).when(board <= 2, 0.2).otherwise(0.1)


def tradable(price: Column, volume: Column, blocked: Column) -> Column:
    return F.coalesce((price > 0) & (volume > 0) & ~blocked, F.lit(False))


def top_with_cap(df: DataFrame, score: str, group: str, k: int, cap: int) -> DataFrame:
    """Per date the k best by score with at most ``cap`` of a group; ties by symbol."""
    inner = Window.partitionBy("date", group).orderBy(F.desc(score), "symbol")
    outer = Window.partitionBy("date").orderBy(F.desc(score), "symbol")
    best = df.where(F.col(score).isNotNull()).withColumn("_g", F.row_number().over(inner)).where(F.col("_g") <= cap)
    return best.withColumn("pos", F.row_number().over(outer)).where(F.col("pos") <= k).drop("_g")


def select_with_buffer(scores: list[tuple[str, float, str]], held: set[str], k: int, buffer: int, cap: int, drop: int | None = None) -> list[str]:
    """The next holdings: held names stay while they rank within ``buffer``; the rest fill by rank under the cap.

    ``drop`` bounds how many held names may go at once (the worst go first).
    """
    order = sorted(scores, key=lambda s: (-s[1], s[0]))
    rank = {s: i for i, (s, *_) in enumerate(order)}
    group = {s: g for s, _, g in order}
    stay = sorted((s for s in held if s in rank), key=lambda s: rank[s])
    leave = [s for s in stay if rank[s] >= buffer]
    if drop is not None and len(leave) > drop:
        leave = leave[-drop:] if drop else []
    out, used = [], {}
    for s in [s for s in stay if s not in set(leave)] + [s for s, *_ in order if s not in held]:
        if len(out) < k and used.get(group[s], 0) < cap:
            out.append(s)
            used[group[s]] = used.get(group[s], 0) + 1
    return out


@dataclass(frozen=True)
class Rules:
    """How the daily engine trades."""

    cash: float = 1e7
    k: int = 20
    buffer: int = 30
    cap: int = 8
    lot: int = 100
    rate: float = 0.001
    fee: float = 5.0
    turnover: float = 0.5  # of equity and rebalance, both sides together; the first build is exempt
    every: int = 5
    target_vol: float | None = None
    floor: float = 0.3


def exposure(history: list[float], r: Rules) -> float:
    """Share of equity to invest: the volatility target over the last 20 returns, less after falls of 10 and 20 %."""
    e = 1.0
    if r.target_vol and len(history) > 20:
        ret = np.diff(history[-21:]) / np.array(history[-21:-1])
        vol = ret.std(ddof=1) * np.sqrt(252)
        e = min(1.0, r.target_vol / vol) if vol > 0 else 1.0
    fall = 1 - history[-1] / max(history) if history else 0.0
    return max(r.floor, e * (0.5 if fall > 0.2 else 0.75 if fall > 0.1 else 1.0))


NAV = "scenario string, date date, equity double, turnover double, cost double, n_holdings int, rebalanced boolean"


#: A day's columns as arrays, by symbol.
Day = dict[str, np.ndarray]


def over_days(days: Callable) -> Callable:
    """An engine for one scenario's rows as a table, from a generator over its days; ``simulate`` streams the days."""

    @functools.wraps(days)
    def engine(pdf: pd.DataFrame, *args, **kw) -> pd.DataFrame:
        each = ((date, {c: day[c].to_numpy() for c in day.columns}) for date, day in pdf.sort_values(["date", "symbol"]).groupby("date", sort=True))
        return pd.DataFrame([(pdf["scenario"].iloc[0], *row) for row in days(each, *args, **kw)], columns=[c.split()[0] for c in NAV.split(", ")])

    engine.days = days
    return engine


@over_days
def daily_engine(days: Iterator[tuple[object, Day]], r: Rules):
    """Signals at the close, fills at the next open: sales first, then buys by weight, in lots, within cash and budget.

    A day: symbol, open, close, volume, score, grp, no_buy, no_sell.
    """
    cash, shares, last = r.cash, {}, {}
    history: list[float] = []
    wanted, first = None, True
    for t, (date, day) in enumerate(days):
        symbols = day["symbol"].tolist()
        px = dict(zip(symbols, day["open"].tolist(), strict=True))
        vol = dict(zip(symbols, day["volume"].tolist(), strict=True))
        stop = {side: dict(zip(symbols, day[side].tolist(), strict=True)) for side in ("no_buy", "no_sell")}
        can = lambda s, side: px.get(s, 0) > 0 and vol.get(s, 0) > 0 and not stop[side].get(s, True)  # noqa: B023, E731
        cost = traded = 0.0
        done = wanted is not None
        if done:
            equity = cash + sum(n * (px.get(s) or last[s]) for s, n in shares.items())
            each = equity * exposure(history, r) / max(len(wanted), 1)
            budget = float("inf") if first else r.turnover * equity
            spent = 0.0
            aim = {s: int(each / px[s] / r.lot) * r.lot for s in wanted if px.get(s, 0) > 0}
            for s in sorted(shares):
                n = shares[s] - (aim.get(s, shares[s]) if s in wanted else 0)
                if n > 0 and can(s, "no_sell"):
                    n = min(n, int((budget / 2 - spent) / px[s] / r.lot) * r.lot) if budget < float("inf") else n
                    if n > 0:
                        fee = max(r.fee, n * px[s] * r.rate)
                        cash += n * px[s] - fee
                        cost, traded, spent = cost + fee, traded + n * px[s], spent + n * px[s]
                        shares[s] -= n
            shares = {s: n for s, n in shares.items() if n}
            for s in wanted:
                n = aim.get(s, 0) - shares.get(s, 0)
                if n > 0 and can(s, "no_buy"):
                    room = min(cash - r.fee, budget - traded)
                    n = min(n, int(room / (px[s] * (1 + r.rate)) / r.lot) * r.lot)
                    if n > 0:
                        fee = max(r.fee, n * px[s] * r.rate)
                        cash -= n * px[s] + fee
                        cost, traded = cost + fee, traded + n * px[s]
                        shares[s] = shares.get(s, 0) + n
            first, wanted = first and not shares, None
        last |= {s: c for s, c in zip(symbols, day["close"].tolist(), strict=True) if c > 0}
        equity = cash + sum(n * last[s] for s, n in shares.items())
        history.append(equity)
        yield date, equity, traded / equity, cost, len(shares), done
        if t % r.every == 0:
            ok = ~np.isnan(day["score"])
            wanted = select_with_buffer(list(zip(*(day[c][ok].tolist() for c in ("symbol", "score", "grp")), strict=True)), set(shares), r.k, r.buffer, r.cap)


@over_days
def weekly_engine(days: Iterator[tuple[object, Day]], share: float = 0.1, bps: float = 10.0):
    """Equal weights of the top ``share`` by score, refilled every week at the open, cost by traded value."""
    weights: dict = {}
    last: dict = {}
    equity, wanted = 1.0, None
    for date, day in days:
        op, cl = (dict(zip(day["symbol"].tolist(), day[c].tolist(), strict=True)) for c in ("open", "close"))
        value = {s: w * (op.get(s, last[s]) / last[s]) for s, w in weights.items()}
        cash = equity - sum(weights.values())
        traded = 0.0
        if wanted is not None:
            total = cash + sum(value.values())
            blocked = set(day["symbol"][day["no_buy"] | day["no_sell"]].tolist())
            fixed = {s: v for s, v in value.items() if s in blocked or s not in op}
            buy = [s for s in wanted if s in op and s not in blocked and s not in fixed]
            each = max(0.0, total - sum(fixed.values())) / max(len(buy), 1)
            new = fixed | dict.fromkeys(buy, each)
            traded = sum(abs(new.get(s, 0) - value.get(s, 0)) for s in {*new, *value})
            k = 1 - traded * bps / 1e4 / total if total else 1.0
            value = {s: v * k for s, v in new.items()}
            cash = total * k - sum(value.values())
        weights = {s: v * (cl.get(s, op.get(s, last.get(s))) / (op[s] if s in op else last[s])) for s, v in value.items()}
        last = {s: cl.get(s, last.get(s)) for s in weights}  # only held names are kept
        equity = cash + sum(weights.values())
        yield date, equity, traded / equity if equity else 0.0, traded * bps / 1e4, len(weights), wanted is not None
        ok = np.flatnonzero(~np.isnan(day["score"]))
        best = ok[np.argsort(-day["score"][ok], kind="stable")]  # ties by symbol, as the day is
        wanted = day["symbol"][best[: int(len(ok) * share)]].tolist() or wanted


def each_day(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, object, Day]]:
    """(scenario, date, day) of rows in order of scenario, date and symbol; one day is held at a time."""
    held: list[pa.RecordBatch] = []

    def day():
        t = pa.Table.from_batches(held)
        out = t["scenario"][0].as_py(), t["date"][0].as_py(), {c: t[c].to_numpy() for c in t.column_names if c not in ("scenario", "date")}
        held.clear()
        return out

    for b in batches:
        keys = [b.column("scenario").dictionary_encode().indices.to_numpy(zero_copy_only=False), b.column("date").cast(pa.int32()).to_numpy(zero_copy_only=False)]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for lo, hi in zip([0, *new.tolist()], [*new.tolist(), b.num_rows], strict=True):
            part = b.slice(lo, hi - lo)
            if held and part.num_rows and any(part.column(c)[0] != held[0].column(c)[0] for c in ("scenario", "date")):
                yield day()
            if part.num_rows:
                held.append(part)
    if held:
        yield day()


def simulate(df: DataFrame, engine, *args) -> DataFrame:
    """An engine per scenario; scenarios run side by side, days of one are in sequence by nature.

    Rows are sorted by Spark and streamed: Python holds a day's rows and the engine's state, not a scenario.
    """
    schema = to_arrow_schema(StructType.fromDDL(NAV))

    def run(batches):
        for scenario, days in groupby(each_day(batches), key=lambda x: x[0]):
            rows = [(scenario, *row) for row in engine.days(((date, day) for _, date, day in days), *args)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return df.repartition("scenario").sortWithinPartitions("scenario", "date", "symbol").mapInArrow(run, NAV)


def performance(nav: DataFrame, by: str, value: str, order: str, periods: float) -> DataFrame:
    """Total and annual return, deviation, Sharpe, largest fall, best and worst period and share of gains of each series."""
    w = Window.partitionBy(by).orderBy(order)
    x = nav.withColumn("_r", F.col(value) / F.lag(value).over(w) - 1).withColumn("_peak", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last, start = F.max_by(value, order), F.min_by(value, order)
    n = F.count("_r")
    return x.groupBy(by).agg(
        n.alias("periods"), (last / start - 1).alias("total"), (F.pow(last / start, periods / n) - 1).alias("annual"),
        (F.stddev_samp("_r") * periods**0.5).alias("vol"), (F.avg("_r") / F.nullif(F.stddev_samp("_r"), F.lit(0.0)) * periods**0.5).alias("sharpe"),
        F.max(1 - F.col(value) / F.col("_peak")).alias("max_dd"), F.max("_r").alias("best"), F.min("_r").alias("worst"),
        F.avg((F.col("_r") > 0).cast("double")).alias("wins"),
    )
