"""The factors.  ``E`` keeps divisions defined; many windows accept one value."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import registry, rolling
from tessera.functions.registry import register
from tessera.operators import crosssection as cs
from tessera.operators import timeseries as ts
from tessera.panel import Panel

E = 1e-12
C = F.col


def _columns() -> None:
    """Columns need a session; factors are registered without one."""
    global o, h, l, c, v, a
    o, h, l, c, v, a = (C(x) for x in ("open", "high", "low", "close", "volume", "amount"))


registry.BEFORE.append(_columns)


def memo(f):
    """One column a panel, however many factors use it."""

    @functools.wraps(f)
    def wrap(p: Panel, *args):
        name = "_".join(["", f.__name__, *map(str, args)])
        if name not in p.df.columns:
            p.let(f(p, *args), name)
        return C(name)

    return wrap


def zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


@memo
def ret(p):
    return ts.padded_pct_change(p, c, 1)


@memo
def previous(p):
    return ts.delay(p, c, 1)


@memo
def change(p, col, n):
    return ts.padded_pct_change(p, C(col), n)


@memo
def true_range(p):
    pc = previous(p)
    return F.greatest(h - l, F.abs(h - pc), F.abs(l - pc))


@memo
def atr(p, n):
    return ts.mean(p, true_range(p), n, 1)


@memo
def down(p, n):
    r = ret(p)
    return ts.std(p, F.when(r < 0, r).otherwise(0.0), n, 1)


@memo
def ema(p, n):
    return ts.ewm_plain(p, c, 2 / (n + 1))


@memo
def macd(p):
    return ema(p, 12) - ema(p, 26)


@memo
def band(p, n):
    m, s = ts.mean(p, c, n, 1), ts.std(p, c, n, 1)
    return F.struct((m - 2 * s).alias("lo"), (m + 2 * s).alias("hi"), m.alias("mid"))


def each(names: str, category: str, requires: str, build, windows=(None,)) -> None:
    """Registers ``names`` with {n} for each window; build(p, n)."""
    for n in windows:
        register(names.format(n=n), category, requires.split(), (lambda p, n=n: build(p, n)) if n is not None else build)


# ---- reversal and momentum
RM = "reversal_momentum"
each("REV{n}", RM, "close", lambda p, n: -change(p, "close", n), (5, 10, 20, 60))
each("MOM{n}", RM, "close", lambda p, n: change(p, "close", n), (20, 60))
each("MOM_SKIP_1M", RM, "close", lambda p: ts.delay(p, c, 21) / (ts.delay(p, c, 252) + E) - 1)
each("MOM_SKIP_1W", RM, "close", lambda p: ts.delay(p, c, 5) / (ts.delay(p, c, 25) + E) - 1)
each("MAX_DD{n}", RM, "close", lambda p, n: ts.path_drawdown(p, c, n), (20, 60))
each("RISK_ADJ_MOM{n}", RM, "close", lambda p, n: change(p, "close", n) / (ts.std(p, ret(p), n) + E), (20, 60))
each("INTRADAY_REV{n}", RM, "open close", lambda p, n: -ts.mean(p, c / (o + E) - 1, n, 1), (5, 10))
each("OVERNIGHT_RET{n}", RM, "open close", lambda p, n: -ts.mean(p, o / (previous(p) + E) - 1, n, 1), (5, 10))
each("CONSEC_UP{n}", RM, "close", lambda p, n: -ts.consecutive_count(p, ts.pct_change(p, c, 1) > 0, n), (3, 5))
each("UP_DOWN_RATIO20", RM, "close", lambda p: ts.mean(p, F.coalesce(ret(p) > 0, F.lit(False)).cast("double"), 20, 1))

# ---- volatility
V = "volatility"
each("DOWN_STD_{n}", V, "close", down, (5, 10, 20, 60))
each("LOW_DOWN_STD_{n}", V, "close", lambda p, n: -down(p, n), (5, 10, 20, 60))
each("LOW_ATR_14", V, "high low close", lambda p: -atr(p, 14))
each("LOW_RANGE_{n}", V, "high low", lambda p, n: -(ts.high(p, h, n, 1) - ts.low(p, l, n, 1)) / (ts.low(p, l, n, 1) + E), (20, 60))
each("NEG_SKEW_20", V, "close", lambda p: -ts.skew(p, ret(p), 20, 5))
each("STD_RET_{n}", V, "close", lambda p, n: -ts.std(p, ret(p), n), (5, 10, 20, 60))
each("VOL_OF_VOL_20", V, "close", lambda p: -ts.std(p, ts.std(p, ret(p), 20, 5), 20, 5))
each("LOW_ATR_PCT_14", V, "high low close", lambda p: -atr(p, 14) / (c + E))

# ---- liquidity
L = "liquidity"
each("LOW_TURNOVER", L, "turnover_rate", lambda p: -zero(C("turnover_rate")))
each("LN_TURNOVER", L, "turnover_rate", lambda p: F.log(zero(C("turnover_rate")) + 1e-6))
each("AMIHUD_20", L, "close amount", lambda p: ts.mean(p, F.abs(ret(p)) / (zero(a) + E), 20, 1))
each("VOL_TREND", L, "volume", lambda p: zero(v) / (ts.mean(p, v, 20, 1) + E))
each("VOL_PRICE_DIVERGENCE", L, "close volume", lambda p: -ts.mean(p, F.when(F.coalesce(F.signum(ret(p)) == F.signum(ts.delta(p, v, 1)), F.lit(False)), 1.0).otherwise(-1.0), 5, 1))

# ---- volume and price
VP = "volume_price"
each("RET_VOL_CORR{n}", VP, "close volume", lambda p, n: -ts.corr(p, ret(p), change(p, "volume", 1), n), (5, 10, 20))
each("RET_AMT_CORR{n}", VP, "close amount", lambda p, n: -ts.corr(p, ret(p), change(p, "amount", 1), n), (10, 20))


def _vwap_dev(p, n):
    w = p.let(ts.total(p, a, n, 1) / (ts.total(p, v, n, 1) + E))
    return (c - w) / (w + E)


each("VWAP_DEV{n}", "technical", "close amount volume", _vwap_dev, (5, 10))
each("AMOUNT_TREND{n}", VP, "amount", lambda p, n: zero(a) / (ts.mean(p, a, n, 1) + E), (5, 20))
each("VOL_CV{n}", VP, "volume", lambda p, n: -ts.std(p, v, n, 1) / (ts.mean(p, v, n, 1) + E), (10, 20))
each("VOL_POS{n}", VP, "volume", lambda p, n: (zero(v) - ts.low(p, v, n, 1)) / (ts.high(p, v, n, 1) - ts.low(p, v, n, 1) + E), (10, 20))
each("MONEY_FLOW{n}", VP, "close amount", lambda p, n: ts.total(p, F.signum(ret(p)) * a, n, 1) / (ts.total(p, a, n, 1) + E), (10, 20))

# ---- technical
T = "technical"


def _rsi(p, n):
    d = ts.delta(p, c, 1)
    gain = ts.mean(p, F.when(d > 0, d).otherwise(F.when(d.isNotNull(), 0.0)), n, 1)
    loss = ts.mean(p, F.when(d < 0, -d).otherwise(F.when(d.isNotNull(), 0.0)), n, 1)
    return 100 - 100 / (1 + gain / (loss + E))


def _kdj(p):
    lo, hi = ts.low(p, l, 9, 1), ts.high(p, h, 9, 1)
    rsv = F.coalesce((c - lo) / (hi - lo + E) * 100, F.lit(50.0))
    k = ts.mean(p, rsv, 3, 1)
    return 3 * k - 2 * ts.mean(p, k, 3, 1)


def _cci(p):
    tp = p.let((h + l + c) / 3)
    m = ts.mean(p, tp, 20, 1)
    return (tp - m) / (0.015 * ts.mean(p, F.abs(tp - m), 20, 1) + E)


def _obv(p):
    step = p.let(F.signum(ts.delta(p, c, 1)) * v)
    total = p.let(F.sum(step).over(p.sofar()))
    old = ts.delay(p, total, 20)
    return (total - old) / (F.abs(old) + E)


def _trix(p, n):
    x = ema(p, n)
    for _ in range(2):
        x = ts.ewm_plain(p, x, 2 / (n + 1))
    return ts.padded_pct_change(p, x, 1)


each("RSI_{n}", T, "close", _rsi, (14, 21))
each("MACD_LINE", T, "close", macd)
each("MACD_HIST", T, "close", lambda p: macd(p) - ts.ewm_plain(p, macd(p), 0.2))
each("KDJ_J", T, "high low close", _kdj)
each("CCI_20", T, "high low close", _cci)
each("BB_BANDWIDTH", T, "close", lambda p: (band(p, 20)["hi"] - band(p, 20)["lo"]) / (band(p, 20)["mid"] + E))
each("BB_POSITION", T, "close", lambda p: (c - band(p, 20)["lo"]) / (band(p, 20)["hi"] - band(p, 20)["lo"] + E))
each("OBV_CHG_20", T, "close volume", _obv)
each("WILLR_{n}", T, "high low close", lambda p, n: (ts.high(p, h, n, 1) - c) / (ts.high(p, h, n, 1) - ts.low(p, l, n, 1) + E), (14, 28))
each("PSY_{n}", T, "close", lambda p, n: ts.mean(p, F.coalesce(ret(p) > 0, F.lit(False)).cast("double"), n, 1), (12, 24))
each("TRIX_{n}", T, "close", _trix, (12, 24))
for _f, _s in ((5, 20), (10, 30)):
    register(f"EMA_CROSS_{_f}_{_s}", T, ["close"], lambda p, f=_f, s=_s: (ema(p, f) - ema(p, s)) / (c + E))

# ---- price structure
PS = "price_structure"


def _place(p, n):
    return (c - ts.low(p, l, n)) / (ts.high(p, h, n) - ts.low(p, l, n) + E)


each("BIAS{n}", PS, "close", lambda p, n: (c - ts.mean(p, c, n)) / (F.abs(ts.mean(p, c, n)) + E), (5, 10, 20, 60))
each("POS_MA{n}", PS, "high low close", _place, (5, 10, 20))
each("CLOSE_POS{n}", PS, "high low close", _place, (5, 20))
each("UPPER_SHADOW{n}", PS, "open high low close", lambda p, n: ts.mean(p, (h - F.greatest(o, c)) / (h - l + E), n, 1), (10, 20))
each("LOWER_SHADOW{n}", PS, "open high low close", lambda p, n: ts.mean(p, (F.least(o, c) - l) / (h - l + E), n, 1), (10, 20))
each("GAP{n}", PS, "open close", lambda p, n: ts.mean(p, (o - previous(p)) / (previous(p) + E), n, 1), (5, 10))
each("MA_ALIGN_5_20", PS, "close", lambda p: (ts.mean(p, c, 5) - ts.mean(p, c, 20)) / (ts.mean(p, c, 20) + E))

# ---- value, quality, growth: one row each; 0 in valuations means missing
for _name, _col in (("EP", "pe_ttm"), ("BP", "pb"), ("SP", "ps_ttm")):
    register(_name, "value", [_col], lambda p, x=_col: F.when(C(x) > 0, 1 / C(x)).otherwise(0.0))
for _name, _col in {"ROE": "roe", "ROA": "roa", "GPM": "grossprofit_margin", "NPM": "netprofit_margin", "CURRENT_RATIO": "current_ratio", "ROE_WAA": "roe_waa", "ROIC": "roic", "QUICK_RATIO": "quick_ratio", "ASSETS_TURN": "assets_turn"}.items():
    register(_name, "quality", [_col], lambda p, x=_col: C(x))
register("LOW_DEBT", "quality", ["debt_to_assets"], lambda p: -C("debt_to_assets"))
REVENUE = ("tr_yoy", "or_yoy", "revenue_yoy")


def _first_present(p: Panel) -> Column:
    return next((C(x) for x in REVENUE if x in p.df.columns), F.lit(None).cast("double"))


register("REV_YOY", "growth", [], _first_present)
for _name, _col in {"PROFIT_YOY": "netprofit_yoy", "OP_YOY": "op_yoy", "OCF_YOY": "ocf_yoy", "ROE_YOY": "roe_yoy", "Q_SALES_YOY": "q_sales_yoy", "Q_OP_QOQ": "q_op_qoq"}.items():
    register(_name, "growth", [_col], lambda p, x=_col: C(x))
register("REV_ACCEL", "growth", [], lambda p: ts.delta(p, _first_present(p), 1), "row to row; a report-to-report change is joins.report_delta")
register("PROFIT_ACCEL", "growth", ["netprofit_yoy"], lambda p: ts.delta(p, C("netprofit_yoy"), 1), "row to row")

# ---- composites: these alternate between symbols and dates


@memo
def vwap(p):
    return C("vwap") if "vwap" in p.df.columns else a / F.when(v != 0, v)


def _finite(x: Column) -> Column:
    return F.when(F.abs(x) < float("inf"), x)


K = "composite"
each("GP_HT_ALPHA1", K, "high amount volume", lambda p: _finite(ts.corr(p, vwap(p) / (h + E), h, 10)))
each("GP_HT_ALPHA2", K, "high low", lambda p: ts.total(p, cs.rank(p, ts.corr(p, h, l, 20)), 20))
each("GP_HT_ALPHA3", K, "volume", lambda p: -ts.std(p, v, 5))
each("GP_HT_ALPHA4", K, "high volume", lambda p: -cs.rank(p, ts.cov(p, h, v, 10)) * cs.rank(p, ts.std(p, h, 10)))
each("GP_HT_ALPHA5", K, "high volume", lambda p: -ts.total(p, cs.rank(p, ts.cov(p, h, v, 5)), 5) * cs.rank(p, ts.std(p, h, 5)))
each("GP_HT_ALPHA6", K, "high low close", lambda p: ts.total(p, (h + l) / (c + E), 5))

# ---- external definitions: 9 bar shapes, 4 prices, and 29 families of rolling features
X, XN = "external", (5, 10, 20, 30, 60)
_top, _bottom, _span = "greatest(open, close)", "least(open, close)", f"(high - low + {E!r}D)"
for _name, _x in {
    "KMID": "(close - open) / open", "KLEN": "(high - low) / open", "KMID2": f"(close - open) / {_span}", "KUP": f"(high - {_top}) / open", "KUP2": f"(high - {_top}) / {_span}",
    "KLOW": f"({_bottom} - low) / open", "KLOW2": f"({_bottom} - low) / {_span}", "KSFT": "(2 * close - high - low) / open", "KSFT2": f"(2 * close - high - low) / {_span}",
    "OPEN0": "open / close", "HIGH0": "high / close", "LOW0": "low / close", "VWAP0": "amount / volume / close",
}.items():
    register(_name, X, ["open", "high", "low", "close"] + ["amount", "volume"] * (_name == "VWAP0"), lambda p, x=_x: F.expr(x))


def _rolls(p: Panel, n: int) -> dict[str, Column]:
    p.df = rolling.rolled(p.df, p.symbol, p.date, n, f"_roll{n}_", FAMILIES)
    return {k: C(f"_roll{n}_{k}") for k in FAMILIES}


def _roll(p: Panel, n: int, family: str) -> Column:
    made = p.__dict__.setdefault("_made", {})
    if n not in made:
        made[n] = _rolls(p, n)
    return made[n][family]


FAMILIES = ("ROC", "MA", "STD", "BETA", "RSQR", "RESI", "MAX", "MIN", "QTLU", "QTLD", "RANK", "RSV", "IMAX", "IMIN", "IMXD", "CORR", "CORD", "CNTP", "CNTN", "CNTD", "SUMP", "SUMN", "SUMD", "VMA", "VSTD", "WVMA", "VSUMP", "VSUMN", "VSUMD")
for _n in XN:
    for _fam in FAMILIES:
        register(f"{_fam}{_n}", X, ["high", "low", "close", "volume"], lambda p, n=_n, f=_fam: _roll(p, n, f))
