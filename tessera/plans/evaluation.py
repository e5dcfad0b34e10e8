"""Queries for the evaluation of factors, signals and portfolios."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import crosssection as cs
from tessera.operators import evaluation as ev
from tessera.operators import models
from tessera.operators import statistics as st
from tessera.operators import timeseries as ts
from tessera.panel import Panel, bars, calendar, meta, table, with_gaps
from tessera.plans.base import META, WEEKS, add, r
from tessera.plans.operators import M_SQL, WINS, fwl
from tessera.plans.portfolio import LIM, _limits
from tessera.plans.statistics import BASE, FACTORS, base, long

C = F.col

# ---- monotonicity and redundancy
_D = range(1, 11)
add("decile_monotonicity", lambda s, d: ev.decile_monotonicity(long(s, d)), f"""WITH {BASE}, k AS (SELECT date, factor, x, y, CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY date, factor, x IS NOT NULL ORDER BY x) + (count(*) OVER (PARTITION BY date, factor, x) - 1) / 2 END AS k,
  count(*) OVER (PARTITION BY date, factor) AS n, count(x) OVER (PARTITION BY date, factor) AS has FROM lg), e AS (SELECT *, min(k) OVER (PARTITION BY date, factor) AS lo, max(k) OVER (PARTITION BY date, factor) AS hi FROM k),
  g AS (SELECT *, CASE WHEN hi = lo THEN 5 ELSE greatest(1, ceil((k - lo) * 10 / (hi - lo))) END AS grp FROM e WHERE x IS NOT NULL AND 2 * (n - has) <= n),
  m AS (SELECT factor, date, {', '.join(f'avg(y) FILTER (grp = {g}) AS d{g}' for g in _D)} FROM g GROUP BY 1, 2), a AS (SELECT factor, {', '.join(f'avg(d{g}) AS d{g}' for g in _D)}, avg(d1 - d10) AS long_short FROM m GROUP BY 1)
  SELECT factor, {', '.join(f'{r(f"d{g}")} AS d{g}' for g in _D)}, {r('long_short')} AS long_short, coalesce(d1 > d10 AND ({' + '.join(f'CASE WHEN d{g + 1} < d{g} THEN 1 ELSE 0 END' for g in range(1, 10))}) >= 5.4, false) AS monotonic FROM a""")  # fmt: skip
_PAIR = [("rev5", "mom20"), ("rev5", "vol10"), ("mom20", "vol10")]
_rank = lambda x, by: f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2"
VALUES = "pv AS (" + " UNION ALL ".join(f"SELECT date, '{a}' AS factor, '{b}' AS other, {a} AS x, {b} AS z FROM bs WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _PAIR) + f"), pk AS (SELECT date, factor, other, {_rank('x', 'date, factor, other')} AS rx, {_rank('z', 'date, factor, other')} AS rz FROM pv), pd AS (SELECT date, factor, other, covar_samp(rx, rz) / nullif(stddev_samp(rx) * stddev_samp(rz), 0) AS c FROM pk GROUP BY 1, 2, 3 HAVING count(*) >= 30)"
add("redundancy_pairs", lambda s, d: ev.value_redundancy(base(s, d), list(FACTORS)), f"WITH {BASE}, {VALUES} SELECT factor, other, {r('avg(c)')} AS corr, {r('avg(abs(c))')} AS abs_corr, count(c) AS days FROM pd WHERE c IS NOT NULL GROUP BY 1, 2")


# ---- raw against neutral
def _neutral_long(s, d):
    p = Panel(base(s, d).join(meta(s, d).select("symbol", "sector", "size"), "symbol"))
    size = p.let(F.log("size"))
    cols = {f: cs.neutralize(p, C(f), size, C("sector")) for f in FACTORS}
    df = p.df.select("symbol", "date", "y", *[c.alias(f"n_{f}") for f, c in cols.items()]).withColumnsRenamed({f"n_{f}": f for f in FACTORS})
    df = df.select("symbol", "date", "y", *[F.round(f, 8).alias(f) for f in FACTORS])
    return st.unpivot(df, ["symbol", "date"], list(FACTORS), ["y"])


NEUTRAL = f"{META}, m0 AS (SELECT bs.*, sector, ln(size) AS sz FROM bs JOIN meta USING (symbol)), {fwl('rev5', 'sector', True, src='m0', out='na')}, {fwl('mom20', 'sector', True, src='na', out='nb')}, {fwl('vol10', 'sector', True, src='nb', out='nc')}, nl AS (" + " UNION ALL ".join(f"SELECT symbol, date, y, '{f}' AS factor, round({v}, 8) AS x FROM nc" for f, v in zip(FACTORS, ("na_v", "nb_v", "nc_v"), strict=True)) + f"), nk AS (SELECT *, {_rank('x', 'date, factor')} AS rx, {_rank('y', 'date, factor')} AS ry FROM nl WHERE x IS NOT NULL AND y IS NOT NULL), ni AS (SELECT date, factor, covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) AS rank_ic FROM nk GROUP BY 1, 2 HAVING count(*) >= 5)"
_sum = lambda k, src: f"SELECT factor, avg(rank_ic) AS {k}, avg(rank_ic) / (stddev_samp(rank_ic) + 1e-12) AS {k}_icir, count(rank_ic) AS {k}_days FROM {src} GROUP BY 1"
add("ic_retention", lambda s, d: ev.retention(st.daily_ic(long(s, d)), st.daily_ic(_neutral_long(s, d))), f"WITH {BASE}, {NEUTRAL}, a AS ({_sum('raw', 'ics')}), n AS ({_sum('neutral', 'ni')}) SELECT factor, {r('raw', 5)} AS raw, {r('raw_icir', 5)} AS raw_icir, raw_days, {r('neutral', 5)} AS neutral, {r('neutral_icir', 5)} AS neutral_icir, neutral_days, {r('neutral - raw', 5)} AS change, {r('neutral / nullif(raw, 0)', 3)} AS retention FROM a LEFT JOIN n USING (factor)", {"retention": 3, **dict.fromkeys(("raw", "raw_icir", "neutral", "neutral_icir", "change"), 5)})
_ann = lambda c, k: f"{r(f'avg({c})')} AS {k}_mean, {r(f'stddev_samp({c})')} AS {k}_std, {r(f'avg({c}) / (stddev_samp({c}) + 1e-12) * sqrt(252)')} AS {k}_ir"
add("ic_annualised", lambda s, d: ev.annualised(st.daily_ic(long(s, d))), f"WITH {BASE} SELECT factor, {_ann('ic', 'ic')}, {_ann('rank_ic', 'rank_ic')}, {r('avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END)')} AS positive, count(*) AS days FROM ics GROUP BY 1")
add("factor_funnel", lambda s, d: ev.funnel(st.ic_summary(st.daily_ic(long(s, d)))).select("factor", "mean", "icir", "kept"), f"WITH {BASE}, a AS ({_sum('m', 'ics')}) SELECT factor, {r('m')} AS mean, {r('m_icir')} AS icir, abs(m) >= 0.01 AND abs(m_icir) > 0.05 AS kept FROM a")


def _matrix(s, d):
    """Rank ICs as a matrix: a column a factor."""
    return st.daily_ic(long(s, d)).groupBy("date").pivot("factor", list(FACTORS)).agg(F.first("rank_ic"))


add("ic_matrix", _matrix, f"WITH {BASE} SELECT date, {', '.join(r(f'max(rank_ic) FILTER (factor = {f!r})') + f' AS {f}' for f in FACTORS)} FROM ics GROUP BY 1")


def _dimension(s, d):
    """Participation ratio of the correlations of daily rank ICs: (tr C)^2 / |C|^2."""
    m = _matrix(s, d).dropna()
    pairs = [st.correlation(a, b).alias(f"c{i}") for i, (a, b) in enumerate(_PAIR)]
    return m.agg(*pairs).select((9 / (3 + 2 * (C("c0") ** 2 + C("c1") ** 2 + C("c2") ** 2))).alias("dimension"))


add("effective_dimension", _dimension, f"WITH {BASE}, m AS (SELECT date, {', '.join(f'max(rank_ic) FILTER (factor = {f!r}) AS {f}' for f in FACTORS)} FROM ics GROUP BY 1), c AS (SELECT corr(rev5, mom20) AS a, corr(rev5, vol10) AS b, corr(mom20, vol10) AS c FROM m WHERE rev5 IS NOT NULL AND mom20 IS NOT NULL AND vol10 IS NOT NULL) SELECT {r('9 / (3 + 2 * (a * a + b * b + c * c))')} AS dimension FROM c")


def _size_corr(s, d):
    """Daily rank correlation of mom20 with size, on dates with at least 30 rows and two sizes."""
    b = base(s, d).join(meta(s, d).select("symbol", "size"), "symbol").where("mom20 IS NOT NULL")
    b = b.withColumns({"a": cs.average_rank(C("mom20"), "date"), "z": cs.average_rank(C("size"), "date")})
    return b.groupBy("date").agg(F.count("*").alias("n"), F.countDistinct("size").alias("k"), st.correlation("a", "z").alias("corr")).where("n >= 30 AND k >= 2").select("date", "n", "corr")


add("size_rank_corr", _size_corr, f"WITH {BASE}, {META}, k AS (SELECT date, size, {_rank('mom20', 'date')} AS a, {_rank('size', 'date')} AS z FROM bs JOIN meta USING (symbol) WHERE mom20 IS NOT NULL) SELECT date, count(*) AS n, {r('covar_samp(a, z) / nullif(stddev_samp(a) * stddev_samp(z), 0)')} AS corr FROM k GROUP BY 1 HAVING count(*) >= 30 AND count(DISTINCT size) >= 2")


# ---- tradability and the way from a signal to a portfolio
def _tradability(s, d):
    df = base(s, d).select("symbol", "date", "mom20").join(_limits(s, d), ["symbol", "date"]).join(bars(s, d).select("symbol", "date", "volume"), ["symbol", "date"])
    period = F.when(C("date") < F.lit("1996-01-01").cast("date"), "train").otherwise("valid")
    return ev.tradability_summary(ev.tradability(df, "mom20", 20), period)


_RATES = ("long_limit_up", "long_lock_up", "short_limit_down", "short_lock_down", "long_suspended", "short_suspended")
_flag = lambda side, x: f"avg(CASE WHEN {x} THEN 1.0 ELSE 0.0 END) FILTER (side = '{side}')"
add("tradability_diagnostics", _tradability, f"""WITH {BASE}, {LIM}, f AS (SELECT symbol, date, volume, coalesce(close >= round_even(pc * (1 + rate), 2) - 0.005, false) AS up, coalesce(close <= round_even(pc * (1 - rate), 2) + 0.005, false) AS down, high = low AS one FROM lm),
  q0 AS (SELECT bs.symbol, bs.date, mom20, volume, up, down, one, count(*) OVER (PARTITION BY date) AS n, quantile_cont(mom20, 0.1) OVER (PARTITION BY date) AS lo, quantile_cont(mom20, 0.9) OVER (PARTITION BY date) AS hi FROM bs JOIN f USING (symbol, date) WHERE mom20 IS NOT NULL),
  sd AS (SELECT *, 'long' AS side FROM q0 WHERE n >= 20 AND mom20 <= lo UNION ALL SELECT *, 'short' FROM q0 WHERE n >= 20 AND mom20 >= hi), st AS (SELECT date, side, list(symbol) AS l FROM sd GROUP BY 1, 2), pv AS (SELECT date, side, l, lag(l) OVER (PARTITION BY side ORDER BY date) AS w FROM st),
  tn AS (SELECT date, sum(1 - len(list_intersect(l, w)) / len(l)) * 0.5 AS turnover FROM pv WHERE w IS NOT NULL GROUP BY 1),
  dy AS (SELECT date, {_flag('long', 'up')} AS long_limit_up, {_flag('long', 'up AND one')} AS long_lock_up, {_flag('short', 'down')} AS short_limit_down, {_flag('short', 'down AND one')} AS short_lock_down, {_flag('long', 'coalesce(volume, 0) <= 0')} AS long_suspended, {_flag('short', 'coalesce(volume, 0) <= 0')} AS short_suspended FROM sd GROUP BY 1)
  SELECT CASE WHEN date < DATE '1996-01-01' THEN 'train' ELSE 'valid' END AS period, count(*) AS days, {', '.join(f'{r(f"avg({c})")} AS {c}' for c in (*_RATES, 'turnover'))}, {r('avg(turnover) * 252')} AS annual_turnover, {', '.join(f'{r(f"avg(turnover) * 252 * {b} / 10000")} AS cost_{b}_bps' for b in (10, 20, 30))} FROM dy LEFT JOIN tn USING (date) GROUP BY 1""")  # fmt: skip


def _diagnosis(s, d):
    p = Panel(base(s, d).join(meta(s, d).select("symbol", "sector", "size"), "symbol").join(bars(s, d).select("symbol", "date", "open"), ["symbol", "date"]))
    w = Window.partitionBy("symbol").orderBy("date")
    fill = p.let(F.lead("open", 6).over(w) / F.lead("open", 1).over(w) - 1)
    alpha = cs.neutralize(p, C("mom20"), p.let(F.log("size")), C("sector"), 20, False)
    df = p.df.select("symbol", "date", C("mom20").alias("pred"), F.round(alpha, 8).alias("alpha"), C("y").alias("label"), fill.alias("fill"))
    return ev.signal_diagnosis(df, 10, 30)


add("signal_diagnosis", _diagnosis, f"""WITH {BASE}, {META}, m0 AS (SELECT bs.*, open, sector, ln(size) AS sz, lead(open, 6) OVER o / lead(open, 1) OVER o - 1 AS fill FROM bs JOIN b USING (symbol, date) JOIN meta USING (symbol) WINDOW o AS (PARTITION BY symbol ORDER BY date)), {fwl('mom20', 'sector', True, 20, False, src='m0', out='na')},
  c AS (SELECT date, symbol, mom20 AS p, round(na_v, 8) AS a, y, fill, count(*) OVER (PARTITION BY date) AS n FROM na WHERE mom20 IS NOT NULL AND na_v IS NOT NULL AND y IS NOT NULL),
  k AS (SELECT *, {_rank('p', 'date')} AS rp, {_rank('a', 'date')} AS ra, {_rank('y', 'date')} AS ry, row_number() OVER (PARTITION BY date ORDER BY p DESC, symbol) <= 10 AS bp, row_number() OVER (PARTITION BY date ORDER BY a DESC, symbol) <= 10 AS ba FROM c WHERE n >= 30)
  SELECT date, count(*) AS n, {r('covar_samp(rp, ry) / nullif(stddev_samp(rp) * stddev_samp(ry), 0)')} AS raw_rank_ic, {r('covar_samp(ra, ry) / nullif(stddev_samp(ra) * stddev_samp(ry), 0)')} AS neutral_rank_ic, {r('avg(y) FILTER (bp)')} AS raw_return, {r('avg(y) FILTER (ba)')} AS neutral_return, {r('avg(fill) FILTER (bp)')} AS raw_fill, {r('avg(fill) FILTER (ba)')} AS neutral_fill,
  {r('covar_samp(y, fill) / nullif(stddev_samp(y) FILTER (fill IS NOT NULL) * stddev_samp(fill), 0)')} AS label_fill, {r('count(*) FILTER (bp AND ba) / 10')} AS overlap FROM k GROUP BY 1""")  # fmt: skip

# ---- limits by board and date, official changes
CODE = "CASE WHEN symbol % 10 = 0 THEN 'BJ' WHEN symbol % 10 <= 2 THEN 'SH68' WHEN symbol % 10 <= 4 THEN 'SZ30' ELSE 'SH60' END"
LIMIT = "CASE WHEN symbol % 10 = 0 THEN 0.3 WHEN symbol % 10 <= 2 THEN 0.2 WHEN symbol % 10 <= 4 AND date >= DATE '1995-01-01' THEN 0.2 ELSE 0.1 END"


def _official(s, d):
    """Flags from the change of the close in per cent, a tenth of it, as unit prices jump between weeks."""
    p = Panel(with_gaps(bars(s, d)))
    change = p.let(F.round(ts.pct_change(p, C("close"), 1) * 10, 2))
    limit = p.let(ev.board_limit(F.expr(CODE), C("date"), Date(1995, 1, 1)))
    up, down = ev.official_limits(change, limit)
    return p.select(limit=limit, change=change, up=up, down=down)


add("limit_flags_official", _official, M_SQL + f"c AS (SELECT symbol, date, CAST({LIMIT} AS DOUBLE) AS l, round((CASE WHEN abs(lag(close) OVER o) > 1e-12 THEN close / lag(close) OVER o - 1 END) * 10, 2) AS c FROM m WINDOW o AS (PARTITION BY symbol ORDER BY date)) SELECT symbol, date, {r('l')} AS limit, {r('c')} AS change, coalesce(c >= l * 100 - 0.5, false) AS up, coalesce(c <= -(l * 100 - 0.5), false) AS down FROM c")


def _masks(s, d):
    """Rows that may train under each mode: all, without limit days, without locked days."""
    f = _limits(s, d)
    ok = {"all": F.lit(True), "limit": ~(C("up") | C("down")), "lock": ~(C("lock_up") | C("lock_down"))}
    return f.select(F.inline(F.array(*[F.struct(F.lit(k).alias("mode"), v.alias("ok")) for k, v in ok.items()]))).groupBy("mode").agg(F.count("*").alias("n"), F.sum(C("ok").cast("int")).alias("kept"))


add("trainable_masks", _masks, f"WITH {WEEKS}, {LIM}, f AS (SELECT coalesce(close >= round_even(pc * (1 + rate), 2) - 0.005, false) AS up, coalesce(close <= round_even(pc * (1 - rate), 2) + 0.005, false) AS down, high = low AS one FROM lm) SELECT mode, count(*) AS n, CAST(sum(CASE WHEN mode = 'all' OR mode = 'limit' AND NOT (up OR down) OR mode = 'lock' AND NOT ((up OR down) AND one) THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM f, (VALUES ('all'), ('limit'), ('lock')) v(mode) GROUP BY 1")


# ---- folds and windows
def _folds(s, d):
    dates = [x.date for x in calendar(base(s, d)).select("date").orderBy("date").collect()]  # a calendar
    rows = [(k, t[0], t[-1], v[0], v[-1]) for k, (t, v) in enumerate(models.multi_folds(dates, 3, 40, 150, 30, 5))]
    return s.createDataFrame(rows, "fold int, train_start date, train_end date, valid_start date, valid_end date")


_CAL = "cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM b))"
add("multi_folds", _folds, f"WITH {WEEKS}, {_CAL}, f AS (SELECT k, (SELECT max(n) FROM cal) - 5 - (2 - k) * 40 AS e FROM range(3) x(k)) SELECT CAST(k AS INTEGER) AS fold, (SELECT date FROM cal WHERE t = e - 185) AS train_start, (SELECT date FROM cal WHERE t = e - 36) AS train_end, (SELECT date FROM cal WHERE t = e - 30) AS valid_start, (SELECT date FROM cal WHERE t = e - 1) AS valid_end FROM f")


def _windows(s, d):
    lo, hi = table(s, d, "orders").agg(F.min(C("o_orderdate").cast("date")), F.max(C("o_orderdate").cast("date"))).first()
    rows = [(w["train"][0], w["train"][1], w["valid"][1], w["test"][1]) for w in models.calendar_windows(lo, hi, 3, 1, 1)]
    return s.createDataFrame(rows, "train_start date, train_end date, valid_end date, test_end date")


add("calendar_windows", _windows, "WITH e AS (SELECT year(min(o_orderdate)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders) SELECT make_date(y, 1, 1) AS train_start, make_date(y + 2, 12, 31) AS train_end, make_date(y + 3, 12, 31) AS valid_end, make_date(y + 4, 12, 31) AS test_end FROM (SELECT unnest(range(lo, lo + 30)) AS y, hi FROM e) WHERE make_date(y + 4, 12, 31) <= hi")

# ---- ridge from moments, and the comparison of models
_X = FACTORS
_m = lambda a, b: f"m_{a}_{b}" if f"m_{a}_{b}" in _MOMENTS else f"m_{b}_{a}"
_COLS = [*_X, "y"]
_MOMENTS = {f"m_{a}_{b}": f"sum({a} * {b}) - count(*) * avg({a}) * avg({b})" for i, a in enumerate(_COLS) for b in _COLS[i:]}
_A = {(i, j): f"({_m(_X[i], _X[j])}{' + 10' if i == j else ''})" for i in range(3) for j in range(3)}


def _det(cells) -> str:
    (a, b, c), (d, e, f), (g, h, i) = cells
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_cells = lambda col: [[_m(_X[i], "y") if j == col else _A[i, j] for j in range(3)] for i in range(3)]
RIDGE = f"""{_CAL}, rz AS (SELECT symbol, date, t, {', '.join(f'coalesce({x}, 0) AS {x}' for x in _X)}, y FROM bs JOIN cal USING (date)), fo AS (SELECT k, 50 * k AS lo, 50 * k + 199 AS hi, 240 + 50 * k AS te FROM range(40) x(k) WHERE 240 + 50 * k + 50 <= (SELECT max(n) FROM cal)),
  mo AS (SELECT k, {', '.join(f'avg({c}) AS a_{c}' for c in _COLS)}, {', '.join(f'{e} AS {n}' for n, e in _MOMENTS.items())} FROM rz JOIN fo ON t BETWEEN lo AND hi WHERE y IS NOT NULL GROUP BY 1),
  rw AS (SELECT *, {', '.join(f'{_det(_cells(j))} / {_det(_cells(None))} AS w{j}' for j in range(3))} FROM mo),
  rp AS (SELECT symbol, date, a_y + {' + '.join(f'w{j} * ({x} - a_{x})' for j, x in enumerate(_X))} AS pred, (SELECT date FROM cal WHERE cal.t = lo) AS train_start, (SELECT date FROM cal WHERE cal.t = hi) AS train_end FROM rz JOIN fo ON t BETWEEN te AND te + 49 JOIN rw USING (k))"""


def _ridge(s, d):
    b = base(s, d)
    dates = [x.date for x in calendar(b).select("date").orderBy("date").collect()]  # a calendar
    return models.ridge_predict(b, list(FACTORS), "y", models.walk_forward(dates, 200, 30, 50, 5))


add("ridge", _ridge, f"WITH {BASE}, {RIDGE} SELECT symbol, date, {r('pred', 5)} AS pred, train_start, train_end FROM rp", 5)


def _comparison(s, d):
    """Ridge, equal weights and weights by mean rank IC on the test dates of ridge, best rank IC first."""
    b = base(s, d)
    weights = models.ic_weights(st.ic_summary(st.daily_ic(long(s, d))))
    score = long(s, d).join(F.broadcast(weights), "factor").groupBy("symbol", "date").agg(F.sum(C("weight") * C("x")).alias("ic_weight"))
    wide = _ridge(s, d).select("symbol", "date", C("pred").alias("ridge")).join(b, ["symbol", "date"]).join(score, ["symbol", "date"])
    wide = wide.withColumn("equal_weight", (C("rev5") + C("mom20") + C("vol10")) / 3)
    names = ["ridge", "equal_weight", "ic_weight"]
    day = st.daily_ic(st.unpivot(wide.select("symbol", "date", "y", *[F.round(n, 7).alias(n) for n in names]), ["symbol", "date"], names, ["y"]))
    out = day.groupBy(C("factor").alias("model")).agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), F.count("*").alias("days"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rank_ic"), "model")).cast("long"))  # one row a model


add("model_comparison", _comparison, f"""WITH {BASE}, {RIDGE}, wt AS (SELECT factor, avg(rank_ic) / sum(abs(avg(rank_ic))) OVER () AS weight FROM ics GROUP BY 1), sc AS (SELECT symbol, date, sum(weight * x) AS v FROM lg JOIN wt USING (factor) GROUP BY 1, 2),
  al AS (SELECT symbol, date, 'ridge' AS model, round(pred, 7) AS x, y FROM rp JOIN bs USING (symbol, date) UNION ALL SELECT symbol, date, 'equal_weight', round((rev5 + mom20 + vol10) / 3, 7), y FROM rp JOIN bs USING (symbol, date) UNION ALL SELECT symbol, date, 'ic_weight', round(v, 7), y FROM rp JOIN bs USING (symbol, date) JOIN sc USING (symbol, date)),
  k AS (SELECT *, {_rank('x', 'date, model')} AS rx, {_rank('y', 'date, model')} AS ry FROM al WHERE x IS NOT NULL AND y IS NOT NULL), i AS (SELECT date, model, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS ic, covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) AS rank_ic FROM k GROUP BY 1, 2 HAVING count(*) >= 5),
  a AS (SELECT model, avg(ic) AS ic, avg(rank_ic) AS rank_ic, count(*) AS days FROM i GROUP BY 1) SELECT model, {r('ic', 4)} AS ic, {r('rank_ic', 4)} AS rank_ic, days, row_number() OVER (ORDER BY a.rank_ic DESC, model) AS place FROM a""", 4)  # fmt: skip


# ---- performance
def _portfolio(s, d):
    """Net values of sectors against the mean of all, with turnover and costs made from their changes."""
    b = bars(s, d).join(meta(s, d).select("symbol", "sector"), "symbol")
    nav = b.groupBy("sector", "date").agg(F.avg("close").alias("nav"), F.count("*").alias("selected"), F.sum((C("close") > C("high") * 0.999).cast("int")).alias("blocked_buy"), F.sum((C("close") < C("low") * 1.001).cast("int")).alias("blocked_sell"))
    bench = bars(s, d).groupBy("date").agg(F.avg("close").alias("benchmark"))
    w = Window.partitionBy("sector").orderBy("date")
    nav = nav.join(bench, "date").withColumn("turnover", F.when(F.row_number().over(w) % 4 == 2, F.least(F.abs(C("nav") / F.lag("nav").over(w) - 1), F.lit(0.5))).otherwise(0.0))
    return nav.withColumn("cost", C("turnover") * C("nav") * 0.001)


_ratio = lambda e: f"avg({e}) / (stddev_samp({e}) + 1e-12) * sqrt(52)"
_grow = lambda c: f"(pow(arg_max({c}, date) / arg_min({c}, date), 1 / greatest(count(ret) / 52.0, 1 / 52.0)) - 1)"
_YEARS = "greatest(count(ret) / 52.0, 1 / 52.0)"
METRICS = f"""nv AS (SELECT sector, date, avg(close) AS nav, count(*) AS selected, sum(CASE WHEN close > high * 0.999 THEN 1 ELSE 0 END) AS bb, sum(CASE WHEN close < low * 1.001 THEN 1 ELSE 0 END) AS bsl FROM b JOIN meta USING (symbol) GROUP BY 1, 2), bn AS (SELECT date, avg(close) AS benchmark FROM b GROUP BY 1),
  x0 AS (SELECT nv.*, benchmark, CASE WHEN row_number() OVER w % 4 = 2 THEN least(abs(nav / lag(nav) OVER w - 1), 0.5) ELSE 0 END AS turnover FROM nv JOIN bn USING (date) WINDOW w AS (PARTITION BY sector ORDER BY date)),
  x1 AS (SELECT *, turnover * nav * 0.001 AS cost, nav / lag(nav) OVER w - 1 AS ret, benchmark / lag(benchmark) OVER w - 1 AS bret, max(nav) OVER (PARTITION BY sector ORDER BY date) AS peak, sum(CASE WHEN turnover > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY sector ORDER BY date) AS bu, coalesce(lag(nav) OVER w, nav) AS held FROM x0 WINDOW w AS (PARTITION BY sector ORDER BY date)),
  x2 AS (SELECT *, CASE WHEN turnover > 0 AND bu = 1 THEN NULL ELSE turnover END AS kt FROM x1),
  pm AS (SELECT sector, count(ret) AS periods, {_grow('nav')} AS annual_return, {_grow('benchmark')} AS benchmark_annual_return, {_grow('nav')} - {_grow('benchmark')} AS annual_excess_return, stddev_samp(ret) * sqrt(52) AS annual_volatility, {_ratio('ret')} AS sharpe, {_ratio('(ret - bret)')} AS information_ratio, stddev_samp(ret - bret) * sqrt(52) AS tracking_error,
    min(nav / peak - 1) AS max_drawdown, {_grow('nav')} / nullif(abs(min(nav / peak - 1)), 0) AS calmar, arg_max(nav, date) AS final_nav, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) AS win_rate, max(ret) AS best, min(ret) AS worst, avg(kt) AS average_turnover, sum(kt) / {_YEARS} AS annual_turnover, sum(cost) AS total_cost, avg(cost / held) AS cost_ratio,
    CAST(sum(bb) AS BIGINT) AS blocked_buy, CAST(sum(bsl) AS BIGINT) AS blocked_sell, sum(bb) / greatest(sum(selected), 1) AS blocked_buy_rate FROM x2 GROUP BY 1)"""  # fmt: skip
_KEYS = ("annual_return", "benchmark_annual_return", "annual_excess_return", "annual_volatility", "sharpe", "information_ratio", "tracking_error", "max_drawdown", "calmar", "final_nav", "win_rate", "best", "worst", "average_turnover", "annual_turnover", "total_cost", "cost_ratio", "blocked_buy_rate")
add("portfolio_metrics", lambda s, d: ev.portfolio_metrics(_portfolio(s, d), "sector", "date", 52.0), f"WITH {WEEKS}, {META}, {METRICS} SELECT sector, periods, blocked_buy, blocked_sell, {', '.join(f'{r(k, 5)} AS {k}' for k in _KEYS)} FROM pm", 5)
add("preset_score", lambda s, d: ev.preset_score(ev.portfolio_metrics(_portfolio(s, d), "sector", "date", 52.0)).select("sector", "preset_score"), f"WITH {WEEKS}, {META}, {METRICS} SELECT sector, {r('sharpe + 0.5 * information_ratio + 0.75 * annual_excess_return - 0.75 * abs(max_drawdown) - 0.2 * annual_volatility - 2 * average_turnover', 5)} AS preset_score FROM pm", 5)


# ---- memory of trials, taxonomies
def _trials(s, d):
    p = table(s, d, "part")
    t = p.select(C("p_brand").alias("category"), (C("p_partkey") % 97 == 0).alias("passed"), ((C("p_partkey") * 7 % 41 - 20) / 1000.0 * F.when(C("p_size") > 25, 2).otherwise(0.9)).alias("rank_ic"), F.when(C("p_size") % 3 > 0, C("p_size") / 50).alias("turnover"))
    return ev.trial_memory(t)


add("trial_memory", _trials, f"WITH t AS (SELECT p_brand AS category, p_partkey % 97 = 0 AS passed, (p_partkey * 7 % 41 - 20) / 1000.0 * CASE WHEN p_size > 25 THEN 2 ELSE 0.9 END AS ic, CASE WHEN p_size % 3 > 0 THEN p_size / 50 END AS tv FROM part), g AS (SELECT category, count(*) AS trials, CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS passed, max(abs(CAST(ic AS DOUBLE))) AS best, avg(tv) AS tv FROM t GROUP BY 1) SELECT category, trials, passed, {r('best')} AS best, {r('tv')} AS turnover, CASE WHEN passed > 0 THEN 'open' WHEN trials >= 3 AND best < 0.02 THEN 'closed_sterile' ELSE 'probing' END AS status FROM g")


def _taxonomies(s, d):
    k = table(s, d, "supplier").select(C("s_suppkey").alias("symbol"), C("s_nationkey").alias("n"))
    day = lambda c: F.date_add(F.lit("1994-01-01").cast("date"), c.cast("int"))
    old = k.select("symbol", F.when(C("symbol") % 11 != 0, C("n")).alias("industry"), day(C("symbol") % 700).alias("start_date"), F.when(C("symbol") % 3 == 0, day(C("symbol") * 13 % 900)).alias("end_date"))
    new = k.select("symbol", (C("n") + 100).alias("industry"), day(C("symbol") * 3 % 1200).alias("start_date"), F.when(C("symbol") % 4 == 0, day(1200 + C("symbol") % 300)).alias("end_date"))
    more = new.where("symbol % 4 = 0").select("symbol", (C("industry") + 100).alias("industry"), F.date_sub("end_date", (C("symbol") % 8).cast("int")).alias("start_date"), F.lit(None).cast("date").alias("end_date"))
    return ev.industry_intervals(old, new.unionByName(more), Date(1995, 6, 1))


_day = lambda x: f"DATE '1994-01-01' + CAST({x} AS INTEGER)"
add("industry_intervals", _taxonomies, f"""WITH k AS (SELECT s_suppkey AS symbol, s_nationkey AS n FROM supplier), o AS (SELECT symbol, CASE WHEN symbol % 11 <> 0 THEN n END AS industry, {_day('symbol % 700')} AS s, CASE WHEN symbol % 3 = 0 THEN {_day('symbol * 13 % 900')} END AS e FROM k),
  w AS (SELECT symbol, n + 100 AS industry, {_day('symbol * 3 % 1200')} AS s, CASE WHEN symbol % 4 = 0 THEN {_day('1200 + symbol % 300')} END AS e FROM k), w2 AS (SELECT * FROM w UNION ALL SELECT symbol, industry + 100, e - CAST(symbol % 8 AS INTEGER), NULL FROM w WHERE symbol % 4 = 0),
  u AS (SELECT symbol, industry, s AS start_date, least(coalesce(e, DATE '1995-06-01'), DATE '1995-06-01') AS end_date, 'old' AS version FROM o WHERE industry IS NOT NULL AND (e IS NULL OR e > s) UNION SELECT symbol, industry, greatest(s, DATE '1995-06-01'), e, 'new' FROM w2 WHERE e IS NULL OR e > s),
  v AS (SELECT * FROM u WHERE end_date IS NULL OR start_date < end_date) SELECT *, coalesce(row_number() OVER q > 1 AND start_date < coalesce(lag(end_date) OVER q, DATE '9999-12-31'), false) AS overlaps FROM v WINDOW q AS (PARTITION BY symbol ORDER BY start_date, industry, version)""")  # fmt: skip


# ---- neutralising with several controls, filled features
def _controls(s, d):
    p = Panel(with_gaps(bars(s, d)).join(meta(s, d), "symbol"))
    group = p.let(F.when(C("symbol") % 13 != 0, C("sector")))
    controls = [p.let(F.log("size")), p.let(F.log("volume")), p.let(C("high") / C("low")), p.let(F.log("amount") / 10)]
    return p.select(v=ev.neutralize_controls(p, C("close"), group, controls, 50))


def _take_out(k: int, src: str) -> str:
    """SQL step: control ``k`` (1..4) out of those after it and of e5."""
    den = f"sum(e{k} * e{k}) OVER (PARTITION BY date)"
    later = ", ".join(f"e{j} - coalesce(CASE WHEN {den} > 1e-9 THEN sum(e{j} * e{k}) OVER (PARTITION BY date) / {den} END, 0) * e{k} AS e{j}" for j in range(k + 1, 6))
    return f"g{k} AS (SELECT * REPLACE ({later}) FROM {src})"


add("neutralize_controls", _controls, M_SQL + f"""ct AS (SELECT symbol, date, close, CASE WHEN symbol % 13 <> 0 THEN sector END AS gr, sz AS c1, ln(volume) AS c2, high / low AS c3, ln(amount) / 10 AS c4 FROM m), c5 AS (SELECT *, close IS NOT NULL AND gr IS NOT NULL AS ok FROM ct),
  md AS (SELECT *, quantile_cont(close, 0.5) FILTER (ok) OVER (PARTITION BY date) AS med FROM c5), mx AS (SELECT *, quantile_cont(abs(close - med), 0.5) FILTER (ok) OVER (PARTITION BY date) AS dev FROM md), my AS (SELECT *, greatest(med - 5 * dev, least(med + 5 * dev, close)) AS yc FROM mx),
  g0 AS (SELECT symbol, date, ok, {', '.join(f'CASE WHEN ok THEN c{k} - avg(c{k}) OVER q END AS e{k}' for k in range(1, 5))}, CASE WHEN ok THEN yc - avg(yc) OVER q END AS e5 FROM my WINDOW q AS (PARTITION BY date, gr, ok)), {_take_out(1, 'g0')}, {_take_out(2, 'g1')}, {_take_out(3, 'g2')}, {_take_out(4, 'g3')}
  SELECT symbol, date, {r('CASE WHEN ok AND count(*) FILTER (ok) OVER d >= 50 THEN (e5 - avg(e5) OVER d) / (stddev_samp(e5) OVER d + 1e-12) END', 4)} AS v FROM g4 WINDOW d AS (PARTITION BY date)""", 4)  # fmt: skip


def _filled(s, d):
    """Features for models: winsorised, neutralised, standardised, missing as 0."""
    p = Panel(with_gaps(bars(s, d)).join(meta(s, d), "symbol"))
    ind = p.let(F.when(C("symbol") % 13 != 0, C("industry")))
    return p.select(v=F.coalesce(cs.standardize(p, cs.neutralize(p, cs.winsorize(p, C("close")), p.let(F.log("size")), ind)), F.lit(0.0)))


add("cs_pipeline_filled", _filled, M_SQL + f"wz AS (SELECT *, {WINS.format(x='close')} AS cw FROM m WINDOW d AS (PARTITION BY date)), " + fwl("cw", "ind", True, src="wz") + f" SELECT symbol, date, {r('coalesce(CASE WHEN stddev_samp(nt_v) OVER d <= 1e-12 THEN 0 * nt_v ELSE (nt_v - avg(nt_v) OVER d) / (stddev_samp(nt_v) OVER d + 1e-12) END, 0)', 5)} AS v FROM nt WINDOW d AS (PARTITION BY date)", 5)
add("ts_range_place", lambda s, d: (lambda p: p.select(v=ts.full(p, C("close"), 10, (C("close") - F.min("close").over(p.last(10))) / (F.max("close").over(p.last(10)) - F.min("close").over(p.last(10)) + 1e-12))))(Panel(bars(s, d))),
    f"WITH {WEEKS} SELECT symbol, date, {r('CASE WHEN count(close) OVER w = 10 THEN (close - min(close) OVER w) / (max(close) OVER w - min(close) OVER w + 1e-12) END')} AS v FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING)")
