"""Queries for the time-series and cross-sectional operators and the formula language."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import crosssection as cs
from tessera.operators import dsl
from tessera.operators import timeseries as ts
from tessera.panel import Panel, bars, meta, with_gaps
from tessera.plans.base import BEFORE, GAPS, META, WEEKS, add, add_panel, r

C = F.col


def _columns() -> None:
    """Columns need a session; queries are listed without one."""
    global close, volume, high, low, _ind
    close, volume, high, low = C("close"), C("volume"), C("high"), C("low")
    _ind = F.when(C("symbol") % 13 != 0, C("industry"))


BEFORE.append(_columns)


def full(x: str, e: str, n: int = 10) -> str:
    return f"CASE WHEN count({x}) OVER w = {n} THEN {e} END"


PCT = "CASE WHEN abs(lag({x}, {n}) OVER o) > 1e-12 THEN {x} / lag({x}, {n}) OVER o - 1 END"

add_panel("ts_delay", lambda p: {"v": ts.delay(p, close, 3)}, {"v": "lag(close, 3) OVER o"})
add_panel("ts_delta", lambda p: {"v": ts.delta(p, close, 3)}, {"v": "close - lag(close, 3) OVER o"})
add_panel("ts_pct_change", lambda p: {"v": ts.pct_change(p, close, 2), "padded": ts.padded_pct_change(p, close, 2)}, {"v": PCT.format(x="close", n=2), "padded": "f / nullif(lag(f, 2) OVER o, 0) - 1"}, ctes="f AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS f FROM g)", source="f", panel="g")
add_panel("ts_mean", lambda p: {"v": ts.mean(p, close, 10)}, {"v": full("close", "avg(close) OVER w")}, panel="g", digits=4)
add_panel("ts_sum", lambda p: {"v": ts.total(p, volume, 10)}, {"v": full("volume", "sum(volume) OVER w")})
add_panel("ts_std", lambda p: {"v": ts.std(p, close, 10)}, {"v": full("close", "stddev_samp(close) OVER w")}, digits=4)
add_panel("ts_median", lambda p: {"v": ts.median(p, close, 10)}, {"v": full("close", "quantile_cont(close, 0.5) OVER w")}, digits=5)
add_panel("ts_quantile", lambda p: {"v": ts.quantile(p, close, 10, 0.8)}, {"v": full("close", "quantile_cont(close, 0.8) OVER w")}, digits=5)
add_panel("ts_min_max", lambda p: {"lo": ts.low(p, close, 10), "hi": ts.high(p, close, 10)}, {"lo": full("close", "min(close) OVER w"), "hi": full("close", "max(close) OVER w")}, panel="g")
add_panel("ts_skew", lambda p: {"v": ts.skew(p, close, 10), "flat": ts.skew(p, F.lit(1.0), 10)}, {"v": full("close", "skewness(close) OVER w"), "flat": full("volume", "0")}, digits=5)
add_panel("ts_kurt", lambda p: {"v": ts.kurt(p, close, 10), "flat": ts.kurt(p, F.lit(1.0), 10)}, {"v": full("close", "kurtosis(close) OVER w"), "flat": full("volume", "-3")}, digits=5)
add_panel("ts_position", lambda p: {"v": ts.position(p, close, 10), "flat": ts.position(p, F.lit(2.0), 10)}, {"v": full("close", "CASE WHEN max(close) OVER w = min(close) OVER w THEN 0.5 ELSE (close - min(close) OVER w) / (max(close) OVER w - min(close) OVER w) END"), "flat": full("volume", "0.5")})
add_panel("ts_rank_pct", lambda p: {"v": ts.rank_pct(p, close, 10)}, {"v": "CASE WHEN len(list_filter(l, lambda v: v IS NOT NULL)) = 10 THEN (len(list_filter(l, lambda v: v < close)) + (len(list_filter(l, lambda v: v = close)) + 1) / 2) / 10 END"}, ctes="l AS (SELECT *, list(close) OVER (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING) AS l FROM g)", source="l", panel="g")
PAIR = "pr AS (SELECT * REPLACE (CASE WHEN volume IS NOT NULL THEN close END AS close, CASE WHEN close IS NOT NULL THEN volume END AS volume) FROM g)"
CORR = "CASE WHEN stddev_samp(close) OVER w > 0 AND stddev_samp(volume) OVER w > 0 THEN covar_samp(close, volume) OVER w / (stddev_samp(close) OVER w * stddev_samp(volume) OVER w) END"
add_panel("ts_corr", lambda p: {"v": ts.corr(p, close, volume, 10)}, {"v": full("close", CORR)}, ctes=PAIR, source="pr", panel="g")
add_panel("ts_cov", lambda p: {"v": ts.cov(p, close, volume, 10)}, {"v": full("close", "covar_samp(close, volume) OVER w")}, ctes=PAIR, source="pr", panel="g", digits=3)
add_panel("ts_rsquare", lambda p: {"v": ts.rsquare(p, close, volume, 10)}, {"v": full("close", f"pow({CORR}, 2)")}, ctes=PAIR, source="pr", panel="g")
add_panel("ts_mad", lambda p: {"v": ts.mad(p, close, 10)}, {"v": full("close", "list_sum(list_transform(l, lambda v: abs(v - m))) / 10")}, ctes="l AS (SELECT *, list(close) OVER w AS l, avg(close) OVER w AS m FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING))", source="l", digits=4)


def ewm(x: str, alpha: float, keep: int) -> str:
    """A fold over the last ``keep`` values."""
    return f"list_reduce(list_filter(list({x}) OVER (PARTITION BY symbol ORDER BY date ROWS {keep - 1} PRECEDING), lambda v: v IS NOT NULL), lambda y, v: y * {1 - alpha!r} + v * {alpha!r})"


A10 = 2 / 11
add_panel("ewm_mean", lambda p: {"v": ts.ewm_mean(p, close, 10)}, {"v": "CASE WHEN close IS NOT NULL AND run >= 10 THEN y END"}, panel="g", digits=5, source="e",
    ctes=f"seg AS (SELECT *, sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS seg FROM g), e AS (SELECT *, count(close) OVER s AS run, CASE WHEN count(close) OVER s > 0 THEN list_reduce(list_filter(list(close) OVER s, lambda v: v IS NOT NULL), lambda y, v: y * {1 - A10!r} + v * {A10!r}) END AS y FROM seg WINDOW s AS (PARTITION BY symbol, seg ORDER BY date ROWS UNBOUNDED PRECEDING))")
UP = "(close > lag(close) OVER o)"
UPS = f"u AS (SELECT *, CAST({UP} AS INT) AS c, row_number() OVER o AS k FROM b WINDOW o AS (PARTITION BY symbol ORDER BY date))"
add_panel("ts_count", lambda p: {"v": ts.count(p, close > F.lag("close").over(p.order()), 10)}, {"v": full("c", "sum(c) OVER w")}, ctes=UPS, source="u", whole=("v",))
add_panel("ts_consecutive_count", lambda p: {"v": ts.consecutive_count(p, close > F.lag("close").over(p.order()), 10)}, {"v": full("c", "least(10, k - coalesce(max(CASE WHEN c = 0 THEN k END) OVER a, 0))")}, ctes=UPS, source="u", whole=("v",))
KS = "ks AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM b)"
add_panel("ts_slope", lambda p: {"v": ts.slope(p, close, 10)}, {"v": full("close", "regr_slope(close, k) OVER w")}, ctes=KS, source="ks", digits=4)
add_panel("ts_decay_linear", lambda p: {"v": ts.decay_linear(p, close, 10)}, {"v": full("close", "(" + " + ".join(f"{10 - i} * lag(close, {i}) OVER o" for i in range(10)) + ") / 55")}, digits=4)
add_panel("safe_math", lambda p: {
    "div": ts.safe_div(close, volume - 25), "l": ts.log1p(close - 1500), "s": ts.sqrt(close - 1500), "sg": F.signum(close - 1500), "ab": F.abs(close - 1500)},
    {"div": "CASE WHEN abs(volume - 25) > 1e-12 THEN close / (volume - 25) END", "l": "CASE WHEN close - 1500 > -1 THEN ln(1 + (close - 1500)) END",
     "s": "CASE WHEN close >= 1500 THEN sqrt(close - 1500) END", "sg": "sign(close - 1500)", "ab": "abs(close - 1500)"}, panel="g")
add_panel("clip_where", lambda p: {"c": ts.clip(close, 1000, 1600), "w": ts.where(close > 1500, high, low)}, {"c": "CASE WHEN close IS NOT NULL THEN greatest(1000, least(1600, close)) END", "w": "CASE WHEN close IS NULL THEN NULL WHEN close > 1500 THEN high ELSE low END"}, panel="g")
DD = "list_reduce(list_prepend({'p': 0.0, 'f': 0.0}, list_transform(l, lambda v: {'p': v, 'f': 0.0})), lambda s, v: {'p': greatest(s.p, v.p), 'f': greatest(s.f, CASE WHEN s.p > 0 THEN 1 - v.p / greatest(s.p, v.p) ELSE 0 END)}).f"
add_panel("factor_maxdd", lambda p: {"dd20": ts.path_drawdown(p, close, 20)}, {"dd20": full("close", DD, 20)}, n=20, ctes="l AS (SELECT *, list(close) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS l FROM b)", source="l")

# ---- cross-sections
RANK = "CASE WHEN close IS NOT NULL THEN (rank() OVER (PARTITION BY date, close IS NOT NULL ORDER BY close) + (count(close) OVER (PARTITION BY date, close) - 1) / 2) / count(close) OVER d END"
add_panel("cs_rank", lambda p: {"v": cs.rank(p, close)}, {"v": RANK}, panel="g")
add_panel("cs_zscore", lambda p: {"v": cs.zscore(p, close)}, {"v": "CASE WHEN stddev_samp(close) OVER d > 1e-12 THEN (close - avg(close) OVER d) / stddev_samp(close) OVER d END"}, panel="g")
WINS = "CASE WHEN {x} IS NOT NULL THEN greatest(quantile_cont({x}, 0.01) OVER d, least(quantile_cont({x}, 0.99) OVER d, {x})) END"
add_panel("cs_winsorize", lambda p: {"v": cs.winsorize(p, close)}, {"v": WINS.format(x="close")}, panel="g", digits=5)


def _with_meta(s, d):
    return Panel(with_gaps(bars(s, d)).join(meta(s, d), "symbol"))


# suppliers without an industry keep their value; sizes are logarithms
M_SQL = f"WITH {WEEKS}, {GAPS}, {META}, m AS (SELECT g.*, CASE WHEN symbol % 13 <> 0 THEN industry END AS ind, sector, ln(size) AS sz FROM g JOIN meta USING (symbol)), "


def fwl(x: str, group: str, size: bool, least: int = 30, keep: bool = True, src: str = "m", out: str = "nt") -> str:
    """SQL steps of the residual of x on group dummies and size, from normal equations of demeaned values."""
    other = x if keep else "NULL"
    beta = f"coalesce(sum(xt * mt) OVER (PARTITION BY date) / nullif(sum(mt * mt) OVER (PARTITION BY date), 0), 0) * mt" if size else "0"
    return f"""{out}1 AS (SELECT *, ({x} IS NOT NULL AND {group} IS NOT NULL AND sz IS NOT NULL) AS ok FROM {src}),
{out}2 AS (SELECT *, CASE WHEN ok THEN {x} - avg({x}) OVER q END AS xt, CASE WHEN ok THEN sz - avg(sz) OVER q END AS mt FROM {out}1 WINDOW q AS (PARTITION BY date, {group}, ok)),
{out} AS (SELECT * EXCLUDE (ok, xt, mt), CASE WHEN ok AND count(*) FILTER (ok) OVER (PARTITION BY date) >= {least} THEN xt - {beta} ELSE {other} END AS {out}_v FROM {out}2)"""


def _neutral(**kw):
    def run(s, d):
        p = _with_meta(s, d)
        size = p.let(F.log("size")) if kw["size"] else None
        group = _ind if kw["group"] == "ind" else None
        return p.select(v=cs.neutralize(p, close, size, group, keep=kw.get("keep", True)))

    return run


for _name, _group, _size in (("both", "ind", True), ("industry", "ind", False), ("size", "1", True)):
    add(f"cs_neutralize_{_name}", _neutral(group=_group, size=_size), M_SQL + fwl("close", _group, _size) + f" SELECT symbol, date, {r('nt_v', 4)} AS v FROM nt", 4)


def _pipeline(s, d):
    p = _with_meta(s, d)
    w = cs.winsorize(p, close)
    return p.select(v=cs.standardize(p, cs.neutralize(p, w, p.let(F.log("size")), _ind)))


add("cs_pipeline", _pipeline, M_SQL + f"wz AS (SELECT *, {WINS.format(x='close')} AS cw FROM m WINDOW d AS (PARTITION BY date)), " + fwl("cw", "ind", True, src="wz") + f" SELECT symbol, date, {r('CASE WHEN nt_v IS NOT NULL AND stddev_samp(nt_v) OVER d <= 1e-12 THEN 0 ELSE (nt_v - avg(nt_v) OVER d) / (stddev_samp(nt_v) OVER d + 1e-12) END', 5)} AS v FROM nt WINDOW d AS (PARTITION BY date)", 5)


def _score_rank(s, d):
    p = Panel(bars(s, d).join(meta(s, d), "symbol"))
    w = cs.winsorize(p, close)
    n = cs.neutralize(p, w, p.let(F.log("size")), C("industry"), least=20, keep=False)
    z = cs.zscore(p, n)
    k = p.let(F.row_number().over(p.day().orderBy(F.desc_nulls_last(F.round(z, 8)), "symbol")))
    return p.df.select("symbol", "date", z.alias("score"), k.cast("long").alias("k")).where("score IS NOT NULL")


add("score_neutralize_rank", _score_rank, f"WITH {WEEKS}, {META}, m AS (SELECT b.*, industry AS ind, ln(size) AS sz FROM b JOIN meta USING (symbol)), wz AS (SELECT *, {WINS.format(x='close')} AS cw FROM m WINDOW d AS (PARTITION BY date)), " + fwl("cw", "ind", True, 20, False, "wz") + f", z AS (SELECT symbol, date, CASE WHEN stddev_samp(nt_v) OVER d > 1e-12 THEN (nt_v - avg(nt_v) OVER d) / stddev_samp(nt_v) OVER d END AS score FROM nt WINDOW d AS (PARTITION BY date)) SELECT symbol, date, {r('score', 5)} AS score, row_number() OVER (PARTITION BY date ORDER BY round(score, 8) DESC NULLS LAST, symbol) AS k FROM z WHERE score IS NOT NULL", 5)


def _styles(s, d):
    p = _with_meta(s, d)
    x = cs.mad_clip(p, close)
    return p.select(clipped=x, rel=cs.leave_one_out(p, ts.pct_change(p, close, 1), C("industry"), 3))


add("cs_mad_clip_loo", _styles, M_SQL + "md AS (SELECT *, quantile_cont(close, 0.5) OVER (PARTITION BY date) AS med, CASE WHEN abs(lag(close) OVER o) > 1e-12 THEN close / lag(close) OVER o - 1 END AS ret FROM (SELECT m.*, industry FROM m JOIN meta USING (symbol)) WINDOW o AS (PARTITION BY symbol ORDER BY date)), me AS (SELECT *, quantile_cont(abs(close - med), 0.5) OVER (PARTITION BY date) AS dev, count(ret) OVER i AS n, sum(ret) OVER i AS sm FROM md WINDOW i AS (PARTITION BY date, industry)) " + f"SELECT symbol, date, {r('CASE WHEN close IS NOT NULL THEN greatest(med - 5 * dev, least(med + 5 * dev, close)) END', 4)} AS clipped, {r('CASE WHEN n >= 3 AND ret IS NOT NULL THEN (sm - ret) / (n - 1) END', 6)} AS rel FROM me", {"clipped": 4})

# ---- formulas: the production shapes over bars, turnover is volume, quality is open
FORMULAS = {
    1: "SAFE_DIV(TS_MEAN($volume,5),TS_STD(TS_PCT_CHANGE($close,1),20)*SAFE_DIV(TS_MEAN($volume,20),TS_MEAN($volume,5)))",
    2: "TS_STD(TS_PCT_CHANGE($close,1),60)",
    3: "SIGN($open)*LOG1P(ABS($open))-LOG1P($volume)-30*TS_STD(TS_PCT_CHANGE($close,1),20)",
    4: "TS_STD(TS_PCT_CHANGE($close,1),20)",
    5: "WHERE($close>$open,TS_RANK_PCT($close,10),-CS_RANK($volume))+0*TS_DECAY_LINEAR($close,5)",
}
RET = "rt AS (SELECT *, CASE WHEN abs(lag(close) OVER (PARTITION BY symbol ORDER BY date)) > 1e-12 THEN close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 END AS ret FROM b)"
_w = lambda n: f"(PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)"
_f = lambda x, n, f: f"(CASE WHEN count({x}) OVER {_w(n)} = {n} THEN {f}({x}) OVER {_w(n)} END)"
_sd = lambda a, b: f"(CASE WHEN abs({b}) > 1e-12 THEN {a} / {b} END)"
_lists = ", rl AS (SELECT *, list(close) OVER (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING) AS l FROM rt)"
_v1 = _sd(_f("volume", 5, "avg"), f"({_f('ret', 20, 'stddev_samp')} * {_sd(_f('volume', 20, 'avg'), _f('volume', 5, 'avg'))})")
_q = "sign(open) * ln(1 + abs(open)) - ln(1 + volume) - {k} * " + _f("ret", 20, "stddev_samp")
FORMULA_SQL = {
    1: _v1, 2: _f("ret", 60, "stddev_samp"), 3: _q.format(k=30), 4: _f("ret", 20, "stddev_samp"),
    5: f"CASE WHEN close > open THEN CASE WHEN len(l) = 10 THEN (len(list_filter(l, lambda v: v < close)) + (len(list_filter(l, lambda v: v = close)) + 1) / 2) / 10 END ELSE -(rank() OVER (PARTITION BY date ORDER BY volume) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2) / count(*) OVER (PARTITION BY date) END + CASE WHEN count(*) OVER {_w(5)} = 5 THEN 0 END",
}
for _k, _formula in FORMULAS.items():
    add_panel(f"dsl_formula_{_k}", lambda p, f=_formula: {"v": dsl.compile_formula(p, f)}, {"v": FORMULA_SQL[_k]}, ctes=RET + _lists, source="rl", digits=4 if _k == 1 else 6)
