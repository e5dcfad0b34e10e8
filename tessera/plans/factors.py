"""Queries for the factors, by category."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import factors as fx
from tessera.functions import registry
from tessera.panel import Panel, bars
from tessera.plans.base import WEEKS, add, r
from tessera.plans.operators import DD

E = "1e-12"


def w(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)"


def roll(f: str, x: str, n: int) -> str:
    return f"{f}({x}) OVER {w(n)}"


def full(f: str, x: str, n: int, least: int | None = None) -> str:
    return f"(CASE WHEN count({x}) OVER {w(n)} >= {least or n} THEN {f}({x}) OVER {w(n)} END)"


def lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER o"


def ema(x: str, span: int) -> str:
    a = 2 / (span + 1)
    return f"list_reduce(list({x}) OVER u, lambda y, v: y * {1 - a!r} + v * {a!r})"


INPUTS = f"""f AS (SELECT *, volume / 1000 AS turnover_rate, lag(close) OVER o AS pc, close / lag(close) OVER o - 1 AS ret, volume / lag(volume) OVER o - 1 AS dv,
  amount / lag(amount) OVER o - 1 AS da, close - lag(close) OVER o AS d, row_number() OVER o AS k,
  CASE WHEN (symbol + date_diff('day', DATE '1970-01-05', date) // 7) % 10 <> 0 THEN close ELSE 0 END AS pe_ttm
  FROM b WINDOW o AS (PARTITION BY symbol ORDER BY date))"""
WINDOW = "WINDOW o AS (PARTITION BY symbol ORDER BY date), u AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), d AS (PARTITION BY date)"


def inputs(s, d) -> Panel:
    df = bars(s, d)
    week = F.floor(F.datediff("date", F.lit("1970-01-05").cast("date")) / 7)
    return Panel(df.withColumn("turnover_rate", F.col("volume") / 1000).withColumn("pe_ttm", F.when((F.col("symbol") + week) % 10 != 0, F.col("close")).otherwise(0.0)).withColumns({"pb": F.col("volume"), "ps_ttm": F.col("amount"), **{k: F.expr(x) for k, x in FIGURES.items()}}))


def group(name: str, sql: dict[str, str], digits=6, ctes: str = "", source: str = "f", panel=inputs) -> None:
    cols = list(sql)
    of = lambda k: digits if isinstance(digits, int) else digits.get(k, 6)
    text = ", ".join(f"{r(f'CAST({e} AS DOUBLE)', of(k))} AS {k}" for k, e in sql.items())
    add(name, lambda s, d: registry.compute(panel(s, d), cols), f"WITH {WEEKS}, {INPUTS}{', ' + ctes if ctes else ''} SELECT symbol, date, {text} FROM {source} {WINDOW}", digits)


def pct(n: int) -> str:
    return f"(close / {lag('close', n)} - 1)"


def dd(n: int) -> str:
    return f"CASE WHEN k >= {n} THEN " + DD.replace("list_transform(l,", f"list_transform(list_slice(hist, greatest(1, len(hist) - {n - 1}), len(hist)),") + " END"


group("factor_reversal", {
    **{f"REV{n}": f"-{pct(n)}" for n in (5, 10, 20, 60)}, **{f"MOM{n}": pct(n) for n in (20, 60)},
    "MOM_SKIP_1M": f"{lag('close', 21)} / ({lag('close', 252)} + {E}) - 1", "MOM_SKIP_1W": f"{lag('close', 5)} / ({lag('close', 25)} + {E}) - 1",
    **{f"MAX_DD{n}": dd(n) for n in (20, 60)},
    **{f"RISK_ADJ_MOM{n}": f"{pct(n)} / ({full('stddev_samp', 'ret', n)} + {E})" for n in (20, 60)},
    **{f"INTRADAY_REV{n}": "-" + roll("avg", f"close / (open + {E}) - 1", n) for n in (5, 10)},
    **{f"OVERNIGHT_RET{n}": "-" + roll("avg", f"open / (pc + {E}) - 1", n) for n in (5, 10)},
    **{f"CONSEC_UP{n}": f"CASE WHEN count(ret) OVER {w(n)} = {n} THEN -least({n}, k - coalesce(max(CASE WHEN ret <= 0 THEN k END) OVER u, 0)) END" for n in (3, 5)},
    "UP_DOWN_RATIO20": roll("avg", "CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END", 20)}, digits=5,
    ctes="h AS (SELECT *, list(close) OVER (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING) AS hist FROM f)", source="h")

DOWN = "CASE WHEN ret < 0 THEN ret ELSE 0 END"
TR = "greatest(high - low, abs(high - pc), abs(low - pc))"
group("factor_volatility", {
    **{f"DOWN_STD_{n}": roll("stddev_samp", DOWN, n) for n in (5, 10, 20, 60)}, **{f"LOW_DOWN_STD_{n}": "-" + roll("stddev_samp", DOWN, n) for n in (5, 10, 20, 60)},
    "LOW_ATR_14": "-" + roll("avg", TR, 14), **{f"LOW_RANGE_{n}": f"-({roll('max', 'high', n)} - {roll('min', 'low', n)}) / ({roll('min', 'low', n)} + {E})" for n in (20, 60)},
    "NEG_SKEW_20": "-" + full("skewness", "ret", 20, 5), **{f"STD_RET_{n}": "-" + full("stddev_samp", "ret", n) for n in (5, 10, 20, 60)},
    "VOL_OF_VOL_20": "-" + full("stddev_samp", "s20", 20, 5), "LOW_ATR_PCT_14": f"-{roll('avg', TR, 14)} / (close + {E})"},
    digits={"LOW_ATR_14": 4, "NEG_SKEW_20": 5}, ctes=f"s AS (SELECT *, {full('stddev_samp', 'ret', 20, 5)} AS s20 FROM f)", source="s")
group("factor_liquidity", {
    "LOW_TURNOVER": "-turnover_rate", "LN_TURNOVER": "ln(turnover_rate + 1e-6)", "AMIHUD_20": roll("avg", f"abs(ret) / (amount + {E})", 20),
    "VOL_TREND": f"volume / ({roll('avg', 'volume', 20)} + {E})",
    "VOL_PRICE_DIVERGENCE": "-" + roll("avg", "CASE WHEN coalesce(sign(ret) = sign(dvol), false) THEN 1.0 ELSE -1.0 END", 5)},
    digits={"AMIHUD_20": 9}, ctes="q AS (SELECT *, volume - lag(volume) OVER (PARTITION BY symbol ORDER BY date) AS dvol FROM f)", source="q")


def corr(x: str, y: str, n: int, least: int | None = None) -> str:
    ok = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN "
    a, b = f"{ok}{x} END", f"{ok}{y} END"
    s = lambda z: f"stddev_samp({z}) OVER {w(n)}"
    varies = lambda z: f"max({z}) OVER {w(n)} - min({z}) OVER {w(n)} > {E} * greatest(abs(max({z}) OVER {w(n)}), abs(min({z}) OVER {w(n)}))"
    return f"(CASE WHEN count({a}) OVER {w(n)} >= {least or n} AND {varies(a)} AND {varies(b)} THEN covar_samp({a}, {b}) OVER {w(n)} / ({s(a)} * {s(b)}) END)"


def vwap(n: int) -> str:
    return f"({roll('sum', 'amount', n)} / ({roll('sum', 'volume', n)} + {E}))"


group("factor_volume_price", {
    **{f"RET_VOL_CORR{n}": "-" + corr("ret", "dv", n) for n in (5, 10, 20)}, **{f"RET_AMT_CORR{n}": "-" + corr("ret", "da", n) for n in (10, 20)},
    **{f"VWAP_DEV{n}": f"(close - {vwap(n)}) / ({vwap(n)} + {E})" for n in (5, 10)}, **{f"AMOUNT_TREND{n}": f"amount / ({roll('avg', 'amount', n)} + {E})" for n in (5, 20)},
    **{f"VOL_CV{n}": f"-{roll('stddev_samp', 'volume', n)} / ({roll('avg', 'volume', n)} + {E})" for n in (10, 20)},
    **{f"VOL_POS{n}": f"(volume - {roll('min', 'volume', n)}) / ({roll('max', 'volume', n)} - {roll('min', 'volume', n)} + {E})" for n in (10, 20)},
    **{f"MONEY_FLOW{n}": f"{roll('sum', 'sign(ret) * amount', n)} / ({roll('sum', 'amount', n)} + {E})" for n in (10, 20)}})
GAIN, LOSS = "CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END", "CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END"
group("factor_technical", {
    **{f"RSI_{n}": f"100 - 100 / (1 + {roll('avg', GAIN, n)} / ({roll('avg', LOSS, n)} + {E}))" for n in (14, 21)},
    "MACD_LINE": "macd", "MACD_HIST": f"macd - {ema('macd', 9)}", "KDJ_J": f"3 * kk - 2 * {roll('avg', 'kk', 3)}",
    "CCI_20": f"(tp - tm) / (0.015 * {roll('avg', 'abs(tp - tm)', 20)} + {E})",
    "BB_BANDWIDTH": f"4 * {roll('stddev_samp', 'close', 20)} / ({roll('avg', 'close', 20)} + {E})",
    "BB_POSITION": f"(close - ({roll('avg', 'close', 20)} - 2 * {roll('stddev_samp', 'close', 20)})) / (4 * {roll('stddev_samp', 'close', 20)} + {E})",
    "OBV_CHG_20": f"(obv - {lag('obv', 20)}) / (abs({lag('obv', 20)}) + {E})",
    **{f"WILLR_{n}": f"({roll('max', 'high', n)} - close) / ({roll('max', 'high', n)} - {roll('min', 'low', n)} + {E})" for n in (14, 28)},
    **{f"PSY_{n}": roll("avg", "CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END", n) for n in (12, 24)},
    **{f"TRIX_{n}": f"{ema(f'x{n}', n)} / t{n} - 1" for n in (12, 24)},
    "EMA_CROSS_5_20": f"({ema('close', 5)} - {ema('close', 20)}) / (close + {E})", "EMA_CROSS_10_30": f"({ema('close', 10)} - {ema('close', 30)}) / (close + {E})"},
    digits={"MACD_LINE": 4, "MACD_HIST": 4, "RSI_14": 5, "RSI_21": 5, "OBV_CHG_20": 4, "KDJ_J": 5, "CCI_20": 5}, source="y",
    ctes=f"""t1 AS (SELECT *, {ema('close', 12)} - {ema('close', 26)} AS macd, (high + low + close) / 3 AS tp, sum(sign(d) * volume) OVER u AS obv,
      coalesce((close - {roll('min', 'low', 9)}) / ({roll('max', 'high', 9)} - {roll('min', 'low', 9)} + {E}) * 100, 50) AS rsv, {ema('close', 12)} AS e12, {ema('close', 24)} AS e24 FROM f {WINDOW}),
    t2 AS (SELECT *, {roll('avg', 'rsv', 3)} AS kk, {roll('avg', 'tp', 20)} AS tm, {ema('e12', 12)} AS x12, {ema('e24', 24)} AS x24 FROM t1 {WINDOW}),
    t3 AS (SELECT *, {ema('x12', 12)} AS z12, {ema('x24', 24)} AS z24 FROM t2 {WINDOW}), y AS (SELECT *, lag(z12) OVER o AS t12, lag(z24) OVER o AS t24 FROM t3 {WINDOW})""")  # fmt: skip


def place(n: int) -> str:
    return f"(close - {full('min', 'low', n)}) / ({full('max', 'high', n)} - {full('min', 'low', n)} + {E})"


group("factor_price_structure", {
    **{f"BIAS{n}": f"(close - {full('avg', 'close', n)}) / (abs({full('avg', 'close', n)}) + {E})" for n in (5, 10, 20, 60)}, **{f"POS_MA{n}": place(n) for n in (5, 10, 20)}, **{f"CLOSE_POS{n}": place(n) for n in (5, 20)},
    **{f"UPPER_SHADOW{n}": roll("avg", f"(high - greatest(open, close)) / (high - low + {E})", n) for n in (10, 20)}, **{f"LOWER_SHADOW{n}": roll("avg", f"(least(open, close) - low) / (high - low + {E})", n) for n in (10, 20)},
    **{f"GAP{n}": roll("avg", f"(open - pc) / (pc + {E})", n) for n in (5, 10)},
    "MA_ALIGN_5_20": f"({full('avg', 'close', 5)} - {full('avg', 'close', 20)}) / ({full('avg', 'close', 20)} + {E})"})
group("factor_value", {"EP": "CASE WHEN pe_ttm > 0 THEN 1 / pe_ttm ELSE 0 END", "BP": "CASE WHEN volume > 0 THEN 1 / volume ELSE 0 END", "SP": "CASE WHEN amount > 0 THEN 1 / amount ELSE 0 END"}, digits=9)
#: Columns that stand for reported figures, each made of bars in its own way.
FIGURES = {
    "roe": "open / 10", "roa": "high / 20", "grossprofit_margin": "low / close", "netprofit_margin": "open - close", "current_ratio": "high / low", "roe_waa": "open + low", "roic": "high - open",
    "quick_ratio": "volume / 100", "assets_turn": "amount / volume", "debt_to_assets": "low / high", "or_yoy": "open / close - 1", "netprofit_yoy": "close / low - 1", "op_yoy": "high / open", "ocf_yoy": "amount / 1000",
    "roe_yoy": "open * 2 - high", "q_sales_yoy": "volume - 7", "q_op_qoq": "close - low",
}
_QUALITY = {"ROE": "roe", "ROA": "roa", "GPM": "grossprofit_margin", "NPM": "netprofit_margin", "CURRENT_RATIO": "current_ratio", "ROE_WAA": "roe_waa", "ROIC": "roic", "QUICK_RATIO": "quick_ratio", "ASSETS_TURN": "assets_turn"}
_GROWTH = {"REV_YOY": "or_yoy", "PROFIT_YOY": "netprofit_yoy", "OP_YOY": "op_yoy", "OCF_YOY": "ocf_yoy", "ROE_YOY": "roe_yoy", "Q_SALES_YOY": "q_sales_yoy", "Q_OP_QOQ": "q_op_qoq"}
group("factor_quality", {**{k: f"({FIGURES[c]})" for k, c in _QUALITY.items()}, "LOW_DEBT": f"-({FIGURES['debt_to_assets']})"})
group("factor_growth", {**{k: f"({FIGURES[c]})" for k, c in _GROWTH.items()}, **{k: f"({FIGURES[c]}) - lag({FIGURES[c]}) OVER o" for k, c in (("REV_ACCEL", "or_yoy"), ("PROFIT_ACCEL", "netprofit_yoy"))}})


def csrank(x: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date, {x} IS NOT NULL ORDER BY {x}) + (count({x}) OVER (PARTITION BY date, {x}) - 1) / 2) / count({x}) OVER d END)"


def cov(x: str, y: str, n: int) -> str:
    return f"(CASE WHEN count(*) OVER {w(n)} = {n} THEN covar_samp({x}, {y}) OVER {w(n)} END)"


group("factor_composite", {
    "GP_HT_ALPHA1": corr(f"(amount / volume / (high + {E}))", "high", 10), "GP_HT_ALPHA2": full("sum", "r2", 20), "GP_HT_ALPHA3": "-" + full("stddev_samp", "volume", 5),
    "GP_HT_ALPHA4": "-r4 * s4", "GP_HT_ALPHA5": f"-{full('sum', 'r5', 5)} * s5", "GP_HT_ALPHA6": full("sum", f"(high + low) / (close + {E})", 5)}, source="c2", digits=5,
    ctes=f"""c1 AS (SELECT *, round({corr('high', 'low', 20)}, 12) AS x2, round({cov('high', 'volume', 10)}, 6) AS x4, round({full('stddev_samp', 'high', 10)}, 6) AS x4s, round({cov('high', 'volume', 5)}, 6) AS x5, round({full('stddev_samp', 'high', 5)}, 6) AS x5s FROM f),
    c2 AS (SELECT *, {csrank('x2')} AS r2, {csrank('x4')} AS r4, {csrank('x4s')} AS s4, {csrank('x5')} AS r5, {csrank('x5s')} AS s5 FROM c1 {WINDOW})""")  # fmt: skip
KBAR = ("KMID", "KLEN", "KMID2", "KUP", "KUP2", "KLOW", "KLOW2", "KSFT", "KSFT2", "OPEN0", "HIGH0", "LOW0", "VWAP0")
T_, B_ = "greatest(open, close)", "least(open, close)"
group("factor_alpha158_kbar", dict(zip(KBAR, (
    "(close - open) / open", "(high - low) / open", f"(close - open) / (high - low + {E})", f"(high - {T_}) / open", f"(high - {T_}) / (high - low + {E})",
    f"({B_} - low) / open", f"({B_} - low) / (high - low + {E})", "(2 * close - high - low) / open", f"(2 * close - high - low) / (high - low + {E})",
    "open / close", "high / close", "low / close", "amount / volume / close"), strict=True)))


def rolls(n: int) -> dict[str, str]:
    up, mv = "greatest(d, 0) + 0 * d", "abs(d)"
    vup, vmv = "greatest(e, 0) + 0 * e", "abs(e)"
    gain = lambda u, m, s: f"({s[0]} * {roll('sum', u, n)} {s[1]} {roll('sum', m, n)}) / ({roll('sum', m, n)} + {E})"
    at = lambda f, x: f"list_position(list({x}) OVER {w(n)}, {roll(f, x, n)}) / {n}"
    hist = f"list(close) OVER {w(n)}"
    pos, neg = "CASE WHEN d > 0 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END", "CASE WHEN d < 0 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END"
    return {
        "ROC": f"{lag('close', n)} / close", "MA": f"{roll('avg', 'close', n)} / close", "STD": f"{roll('stddev_samp', 'close', n)} / close",
        "BETA": f"regr_slope(close, k) OVER {w(n)} / close", "RSQR": f"pow({corr('close', 'CAST(k AS DOUBLE)', n, 2)}, 2)",
        "RESI": f"(close - (regr_intercept(close, k) OVER {w(n)} + regr_slope(close, k) OVER {w(n)} * k)) / close",
        "MAX": f"{roll('max', 'high', n)} / close", "MIN": f"{roll('min', 'low', n)} / close", "QTLU": f"quantile_cont(close, 0.8) OVER {w(n)} / close", "QTLD": f"quantile_cont(close, 0.2) OVER {w(n)} / close",
        "RANK": "(len(list_filter(hist{n}, lambda z: z < close)) + (len(list_filter(hist{n}, lambda z: z = close)) + 1) / 2) / len(hist{n})".replace("{n}", str(n)),
        "RSV": f"(close - {roll('min', 'low', n)}) / ({roll('max', 'high', n)} - {roll('min', 'low', n)} + {E})",
        "IMAX": at("max", "high"), "IMIN": at("min", "low"), "IMXD": f"{at('max', 'high')} - {at('min', 'low')}",
        "CORR": corr("close", "ln(volume + 1)", n, 2), "CORD": corr("(ret + 1)", "ln(dv + 2)", n, 2),
        "CNTP": roll("avg", pos, n), "CNTN": roll("avg", neg, n), "CNTD": f"{roll('avg', pos, n)} - {roll('avg', neg, n)}",
        "SUMP": f"{roll('sum', up, n)} / ({roll('sum', mv, n)} + {E})", "SUMN": gain(up, mv, ("-1", "+")), "SUMD": gain(up, mv, ("2", "-")),
        "VMA": f"{roll('avg', 'volume', n)} / (volume + {E})", "VSTD": f"{roll('stddev_samp', 'volume', n)} / (volume + {E})",
        "WVMA": f"{roll('stddev_samp', 'abs(ret) * volume', n)} / ({roll('avg', 'abs(ret) * volume', n)} + {E})",
        "VSUMP": f"{roll('sum', vup, n)} / ({roll('sum', vmv, n)} + {E})", "VSUMN": gain(vup, vmv, ("-1", "+")), "VSUMD": gain(vup, vmv, ("2", "-")),
    }


for _n in fx.XN:
    group(f"factor_alpha158_roll_{_n}", {f"{k}{_n}": x for k, x in rolls(_n).items()}, digits=5, source="z", ctes=f"z AS (SELECT *, volume - lag(volume) OVER (PARTITION BY symbol ORDER BY date) AS e, list(close) OVER {w(_n)} AS hist{_n} FROM f)", panel=lambda s, d: Panel(bars(s, d)))
