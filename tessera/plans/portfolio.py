"""Queries for schedules, tradability, selection, simulation, models and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import crosssection as cs
from tessera.operators import models
from tessera.operators import portfolio as pf
from tessera.operators import statistics as st
from tessera.operators import timeseries as ts
from tessera.panel import Panel, bars, calendar, meta, table
from tessera.plans.base import META, WEEKS, add, r
from tessera.plans.statistics import BASE, FACTORS, base, long

C = F.col
DAYS = "dy AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)"


def days(s, d):
    return table(s, d, "orders").select(C("o_orderdate").cast("date").alias("date")).distinct()


add("week_schedule", lambda s, d: pf.week_schedule(days(s, d)), f"WITH {DAYS}, n AS (SELECT date, lead(date) OVER (ORDER BY date) AS nx FROM dy) SELECT max(date) AS signal, arg_max(nx, date) AS execution FROM n GROUP BY isoyear(date), weekofyear(date) HAVING arg_max(coalesce(nx, DATE '9999-01-01'), date) < DATE '9999-01-01'")
add("rebalance_grid", lambda s, d: calendar(days(s, d)).where("(t - 3) % 20 = 0").select("date", C("t").cast("long").alias("t")), f"WITH {DAYS}, n AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM dy) SELECT date, t FROM n WHERE (t - 3) % 20 = 0")


def _limits(s, d):
    p = Panel(bars(s, d))
    pc = ts.delay(p, C("close"), 1)
    rate = p.let(pf.limit_rate(C("symbol")))
    top, bottom = F.bround(pc * (1 + rate), 2), F.bround(pc * (1 - rate), 2)
    up, down = C("close") >= top - 0.005, C("close") <= bottom + 0.005
    one = C("high") == C("low")
    no = F.lit(False)
    return p.select(up=F.coalesce(up, no), down=F.coalesce(down, no), lock_up=F.coalesce(up & one, no), lock_down=F.coalesce(down & one, no))


RATE = "CASE WHEN symbol % 10 = 0 THEN 0.3 WHEN symbol % 10 <= 2 THEN 0.2 ELSE 0.1 END"
LIM = f"lm AS (SELECT *, CAST({RATE} AS DOUBLE) AS rate, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM b)"
add("limit_flags", _limits, f"WITH {WEEKS}, {LIM}, f AS (SELECT symbol, date, coalesce(close >= round_even(pc * (1 + rate), 2) - 0.005, false) AS up, coalesce(close <= round_even(pc * (1 - rate), 2) + 0.005, false) AS down, high = low AS one FROM lm) SELECT symbol, date, up, down, up AND one AS lock_up, down AND one AS lock_down FROM f")


def _open_state(s, d):
    p = Panel(bars(s, d))
    pc = ts.delay(p, C("close"), 1)
    rate = p.let(pf.limit_rate(C("symbol")))
    top, bottom = F.floor(pc * (1 + rate) * 100 + 0.5) / 100, F.floor(pc * (1 - rate) * 100 + 0.5) / 100
    state = F.when(C("open") >= top, "no_buy").when(C("open") <= bottom, "no_sell").otherwise("free")
    return p.select(state=state, tradable=pf.tradable(C("open"), C("volume"), state != "free"))


add("open_limit_state", _open_state, f"WITH {WEEKS}, {LIM}, f AS (SELECT symbol, date, open, volume, CASE WHEN open >= floor(pc * (1 + rate) * 100 + 0.5) / 100 THEN 'no_buy' WHEN open <= floor(pc * (1 - rate) * 100 + 0.5) / 100 THEN 'no_sell' ELSE 'free' END AS state FROM lm) SELECT symbol, date, state, coalesce(open > 0 AND volume > 0 AND state = 'free', false) AS tradable FROM f")


def _topk(s, d):
    b = base(s, d).join(meta(s, d).select("symbol", "sector"), "symbol")
    return pf.top_with_cap(b, "mom20", "sector", 10, 3).select("date", "symbol", C("pos").cast("long").alias("pos"))


add("topk_industry_cap", _topk, f"WITH {BASE}, {META}, g AS (SELECT date, symbol, mom20 FROM bs JOIN meta USING (symbol) WHERE mom20 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date, sector ORDER BY mom20 DESC, symbol) <= 3) SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY mom20 DESC, symbol) AS pos FROM g QUALIFY pos <= 10")


def _utility(s, d):
    """Non-overlapping dates: mean label of the top tenth less costs of its turnover, over the label's spread."""
    b = base(s, d).where("mom20 IS NOT NULL AND y IS NOT NULL").join(F.broadcast(calendar(base(s, d)).where("t % 5 = 0").select("date")), "date")
    n = F.count("*").over(Window.partitionBy("date"))
    k = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("mom20"), "symbol"))
    day = b.withColumn("n", n).withColumn("k", k).groupBy("date").agg(F.collect_set(F.when(C("k") <= F.greatest(F.floor(C("n") * 0.1), F.lit(1)), C("symbol"))).alias("set"), F.avg(F.when(C("k") <= F.greatest(F.floor(C("n") * 0.1), F.lit(1)), C("y"))).alias("ret"), F.stddev_pop("y").alias("sd"))
    was = F.lag("set").over(Window.orderBy("date"))
    turn = F.when(was.isNull(), 1.0).otherwise(1 - F.size(F.array_intersect("set", was)) / F.size("set"))
    day = day.withColumn("turnover", turn)
    return day.select("date", "ret", "turnover", F.try_divide(C("ret") - 0.001 * C("turnover"), F.nullif("sd", F.lit(0.0))).alias("utility"))


add("topk_utility", _utility, f"WITH {BASE}, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM b)), q AS (SELECT bs.date, symbol, y, row_number() OVER (PARTITION BY bs.date ORDER BY mom20 DESC, symbol) AS k, count(*) OVER (PARTITION BY bs.date) AS n FROM bs JOIN cal ON cal.date = bs.date AND t % 5 = 0 WHERE mom20 IS NOT NULL AND y IS NOT NULL), a AS (SELECT date, list(symbol) FILTER (k <= greatest(floor(n * 0.1), 1)) AS s, avg(y) FILTER (k <= greatest(floor(n * 0.1), 1)) AS ret, stddev_pop(y) AS sd FROM q GROUP BY 1), p AS (SELECT *, lag(s) OVER (ORDER BY date) AS w FROM a), z AS (SELECT date, ret, sd, CASE WHEN w IS NULL THEN 1 ELSE 1 - len(list_intersect(s, w)) / len(s) END AS turnover FROM p) SELECT date, {r('ret')} AS ret, {r('turnover')} AS turnover, {r('(ret - 0.001 * turnover) / nullif(sd, 0)')} AS utility FROM z")


def _loo(s, d):
    p = Panel(bars(s, d).join(meta(s, d).select("symbol", "sector"), "symbol"))
    ret = ts.pct_change(p, C("close"), 1)
    loo = cs.leave_one_out(p, ret, C("sector"), 5)
    # unit prices jump between weeks; a tenth of the changes keeps products in range
    own = ts.pct_change(p, C("close"), 20) / 10
    prod = p.let(ts.full(p, loo, 20, F.product(1 + loo / 10).over(p.last(20))))
    return p.select(loo=loo, rel=own - (prod - 1))


LOO = f"{WEEKS}, {META}, rt AS (SELECT b.*, sector, close / lag(close) OVER o - 1 AS ret, close / lag(close, 20) OVER o - 1 AS own FROM b JOIN meta USING (symbol) WINDOW o AS (PARTITION BY symbol ORDER BY date)), lo AS (SELECT *, CASE WHEN count(ret) OVER q >= 5 AND ret IS NOT NULL THEN (sum(ret) OVER q - ret) / (count(ret) OVER q - 1) END AS loo, avg(ret) OVER (PARTITION BY date) AS mkt FROM rt WINDOW q AS (PARTITION BY date, sector))"
W20, W60 = ("(PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)", "(PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING)")
add("loo_industry_return", _loo, f"WITH {LOO} SELECT symbol, date, {r('loo')} AS loo, {r(f'own / 10 - (CASE WHEN count(loo) OVER {W20} = 20 THEN product(1 + loo / 10) OVER {W20} END - 1)', 3)} AS rel FROM lo", {"rel": 3})


def _residual(s, d):
    """Residual of own on market and industry returns by rolling moments over 60 rows, and its 20-row sum."""
    p = Panel(bars(s, d).join(meta(s, d).select("symbol", "sector"), "symbol"))
    y = ts.pct_change(p, C("close"), 1)
    x1 = p.let(F.avg(y).over(p.day()))
    x2 = cs.leave_one_out(p, y, C("sector"), 5)
    ok = y.isNotNull() & x2.isNotNull()
    y, x1, x2 = (p.let(F.when(ok, z)) for z in (y, x1, x2))
    w = p.last(60)
    m = {k: p.let(F.avg(z).over(w)) for k, z in {"y": y, "a": x1, "b": x2, "aa": x1 * x1, "bb": x2 * x2, "ab": x1 * x2, "ay": x1 * y, "by": x2 * y}.items()}
    saa, sbb, sab = m["aa"] - m["a"] ** 2, m["bb"] - m["b"] ** 2, m["ab"] - m["a"] * m["b"]
    say, sby = m["ay"] - m["a"] * m["y"], m["by"] - m["b"] * m["y"]
    det = p.let(saa * sbb - sab * sab)
    safe = F.when(F.abs(det) > 1e-18, det)
    b1, b2 = (say * sbb - sby * sab) / safe, (sby * saa - say * sab) / safe
    e = p.let(ts.full(p, y, 60, y - m["y"] - b1 * (x1 - m["a"]) - b2 * (x2 - m["b"])))
    return p.select(resid=e, mom=ts.total(p, e, 20))


_m = lambda x: f"avg({x}) OVER {W60}"
add("industry_residual", _residual, f"WITH {LOO}, k AS (SELECT symbol, date, CASE WHEN ret IS NOT NULL AND loo IS NOT NULL THEN ret END AS y, CASE WHEN ret IS NOT NULL AND loo IS NOT NULL THEN mkt END AS a, CASE WHEN ret IS NOT NULL AND loo IS NOT NULL THEN loo END AS c FROM lo), m AS (SELECT *, count(y) OVER {W60} AS n, {_m('y')} AS my, {_m('a')} AS ma, {_m('c')} AS mc, {_m('a * a')} AS aa, {_m('c * c')} AS cc, {_m('a * c')} AS ac, {_m('a * y')} AS ay, {_m('c * y')} AS cy FROM k), v AS (SELECT *, aa - ma * ma AS saa, cc - mc * mc AS scc, ac - ma * mc AS sac, ay - ma * my AS say, cy - mc * my AS scy FROM m), z AS (SELECT *, CASE WHEN abs(saa * scc - sac * sac) > 1e-18 THEN saa * scc - sac * sac END AS det FROM v), e AS (SELECT symbol, date, CASE WHEN n = 60 THEN y - my - (say * scc - scy * sac) / det * (a - ma) - (scy * saa - say * sac) / det * (c - mc) END AS e FROM z) SELECT symbol, date, {r('e')} AS resid, {r(f'CASE WHEN count(e) OVER {W20} = 20 THEN sum(e) OVER {W20} END')} AS mom FROM e")


def _weighted(s, d):
    lg = long(s, d)
    w = models.ic_weights(st.ic_summary(st.daily_ic(lg)))
    return lg.join(F.broadcast(w), "factor").groupBy("symbol", "date").agg(F.sum(C("weight") * C("x")).alias("score"))


add("ic_weight_score", _weighted, f"WITH {BASE}, m AS (SELECT factor, avg(rank_ic) AS mean FROM ics GROUP BY 1), w AS (SELECT factor, mean / sum(abs(mean)) OVER () AS weight FROM m) SELECT symbol, date, {r('sum(weight * x)')} AS score FROM lg JOIN w USING (factor) GROUP BY 1, 2")


def _nav(s, d):
    """Equal-weight mean close by sector, as a net value."""
    return bars(s, d).join(meta(s, d).select("symbol", "sector"), "symbol").groupBy("sector", "date").agg(F.avg("close").alias("nav"))


add("perf_metrics", lambda s, d: pf.performance(_nav(s, d), "sector", "nav", "date", 52.0),
    f"WITH {WEEKS}, {META}, n AS (SELECT sector, date, avg(close) AS nav FROM b JOIN meta USING (symbol) GROUP BY 1, 2), x AS (SELECT *, nav / lag(nav) OVER q - 1 AS ret, max(nav) OVER (PARTITION BY sector ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM n WINDOW q AS (PARTITION BY sector ORDER BY date)) SELECT sector, count(ret) AS periods, {r('arg_max(nav, date) / arg_min(nav, date) - 1')} AS total, {r('pow(arg_max(nav, date) / arg_min(nav, date), 52.0 / count(ret)) - 1')} AS annual, {r('stddev_samp(ret) * sqrt(52)')} AS vol, {r('avg(ret) / stddev_samp(ret) * sqrt(52)')} AS sharpe, {r('max(1 - nav / peak)')} AS max_dd, {r('max(ret)')} AS best, {r('min(ret)')} AS worst, {r('avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) FILTER (ret IS NOT NULL)')} AS wins FROM x GROUP BY 1")


def _scenarios(s, d, names):
    """Scores and tradability of every bar; each scenario has a score of its own."""
    b = base(s, d).drop("y")
    p = Panel(bars(s, d))
    pc = ts.delay(p, C("close"), 1)
    rate = p.let(pf.limit_rate(C("symbol")))
    state = p.select(open=C("open"), close=C("close"), volume=C("volume"), no_buy=F.coalesce(C("open") >= pc * (1 + rate), F.lit(False)), no_sell=F.coalesce(C("open") <= pc * (1 - rate), F.lit(False)))
    x = state.join(b, ["symbol", "date"]).join(meta(s, d).select("symbol", C("sector").alias("grp")), "symbol")
    return x.unpivot(["symbol", "date", "open", "close", "volume", "no_buy", "no_sell", "grp"], list(names), "scenario", "score")


add("weekly_engine", lambda s, d: pf.simulate(_scenarios(s, d, FACTORS), pf.weekly_engine))
add("daily_engine", lambda s, d: pf.simulate(_scenarios(s, d, FACTORS), pf.daily_engine, pf.Rules()))


def _model(kind):
    def run(s, d):
        b = base(s, d)
        dates = [x.date for x in calendar(b).select("date").orderBy("date").collect()]  # a calendar
        folds = models.walk_forward(dates, 200, 30, 50, 5)
        return models.rolling_predict(b, list(FACTORS), "y", folds, kind)

    return run


add("gbt", _model("gbt"), None, 4)


def _stream(s, d):
    """Events as a stream of files, deduplicated and counted by day: what a batch gives for the same events."""
    import uuid

    from tessera.streaming import events as ev

    path = f"{d}/events.parquet"
    schema = s.read.parquet(path).schema
    name = f"stream_{uuid.uuid4().hex[:8]}"
    single = s.read.parquet(path).inputFiles()[0].endswith("/events.parquet")
    read = s.readStream.schema(schema)
    src = read.option("pathGlobFilter", "events.parquet").parquet(d) if single else read.parquet(path)
    src = src.withColumn("ts", C("ts").cast("timestamp"))
    q = ev.windowed(src, "ts", "1 day", "1 hour", "event_type", "value").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(600)
    return s.table(name).select(C("window.start").cast("date").alias("day"), "event_type", "n", "total")


add("stream_daily_counts", _stream, f"SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, {r('sum(value)', 4)} AS total FROM events GROUP BY 1, 2", 4)
