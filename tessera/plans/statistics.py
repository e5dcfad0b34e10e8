"""Queries for information coefficients, quantiles, correlations of factors and gates."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import statistics as st
from tessera.operators import timeseries as ts
from tessera.panel import Panel, bars, calendar, meta
from tessera.plans.base import META, WEEKS, add, r
from tessera.plans.operators import RET

C = F.col
FACTORS = ("rev5", "mom20", "vol10")


def base(s, d) -> DataFrame:
    """Three factors and the five-row forward return."""
    p = Panel(bars(s, d))
    close = C("close")
    rev, mom = -ts.pct_change(p, close, 5), ts.pct_change(p, close, 20)
    vol = -ts.std(p, ts.pct_change(p, close, 1), 10)
    y = p.let(F.lead("close", 5).over(p.order()) / close - 1)
    return p.select(rev5=F.round(rev, 9), mom20=F.round(mom, 9), vol10=F.round(vol, 9), y=F.round(y, 9))


def long(s, d) -> DataFrame:
    return st.unpivot(base(s, d), ["symbol", "date"], list(FACTORS), ["y"])


BASE = f"""{WEEKS}, {RET}, bs AS (SELECT symbol, date, round(-(close / lag(close, 5) OVER o - 1), 9) AS rev5, round(close / lag(close, 20) OVER o - 1, 9) AS mom20,
  round(-CASE WHEN count(ret) OVER (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING) = 10 THEN stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING) END, 9) AS vol10,
  round(lead(close, 5) OVER o / close - 1, 9) AS y FROM rt WINDOW o AS (PARTITION BY symbol ORDER BY date)),
lg AS (SELECT symbol, date, y, 'rev5' AS factor, rev5 AS x FROM bs UNION ALL SELECT symbol, date, y, 'mom20', mom20 FROM bs UNION ALL SELECT symbol, date, y, 'vol10', vol10 FROM bs),
ok AS (SELECT *, rank() OVER (PARTITION BY date, factor ORDER BY x) + (count(*) OVER (PARTITION BY date, factor, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY date, factor ORDER BY y) + (count(*) OVER (PARTITION BY date, factor, y) - 1) / 2 AS ry FROM lg WHERE x IS NOT NULL AND y IS NOT NULL),
ics AS (SELECT date, factor, count(*) AS n, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS ic, covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) AS rank_ic FROM ok GROUP BY 1, 2 HAVING count(*) >= 5)"""
add("labels", lambda s, d: Panel(bars(s, d)).df.select("symbol", "date", *[(F.lead("close", h).over(Window.partitionBy("symbol").orderBy("date")) / C("close") - 1).alias(f"label_ret_{h}") for h in (5, 10, 20)]),
    f"WITH {WEEKS} SELECT symbol, date, " + ", ".join(f"{r(f'lead(close, {h}) OVER o / close - 1')} AS label_ret_{h}" for h in (5, 10, 20)) + " FROM b WINDOW o AS (PARTITION BY symbol ORDER BY date)")
add("daily_ic", lambda s, d: st.daily_ic(long(s, d)).select("date", "factor", "n", "ic"), f"WITH {BASE} SELECT date, factor, n, {r('ic')} AS ic FROM ics")
add("daily_rankic", lambda s, d: st.daily_ic(long(s, d)).select("date", "factor", "n", "rank_ic"), f"WITH {BASE} SELECT date, factor, n, {r('rank_ic')} AS rank_ic FROM ics")
add("ic_summary", lambda s, d: st.ic_summary(st.daily_ic(long(s, d))), f"WITH {BASE} SELECT factor, {r('avg(rank_ic)')} AS mean, {r('stddev_samp(rank_ic)')} AS std, count(rank_ic) AS days, {r('avg(rank_ic) / (stddev_samp(rank_ic) + 1e-12)')} AS icir, {r('avg(rank_ic) / (stddev_samp(rank_ic) / sqrt(count(rank_ic)))')} AS t FROM ics GROUP BY 1")
# Student's t with whole degrees as finite series of the angle
P_SQL = f"""WITH {BASE}, a AS (SELECT factor, avg(rank_ic) / (stddev_samp(rank_ic) / sqrt(count(rank_ic))) AS t, count(rank_ic) - 1 AS v FROM ics GROUP BY 1), th AS (SELECT *, atan(abs(t) / sqrt(v)) AS th FROM a WHERE v >= 2),
  tm AS (SELECT factor, v, th, j, coalesce(sum(CASE WHEN j > 0 THEN ln(CASE WHEN v % 2 = 0 THEN (2 * j - 1) / (2 * j) ELSE 2 * j / (2 * j + 1) END * cos(th) * cos(th)) END) OVER (PARTITION BY factor ORDER BY j), 0) AS s FROM (SELECT *, unnest(range(0, CAST(CASE WHEN v % 2 = 0 THEN v / 2 ELSE (v - 1) / 2 END AS BIGINT))) AS j FROM th)),
  sm AS (SELECT factor, sum(exp(s)) AS s FROM tm GROUP BY 1), p AS (SELECT factor, t, 1 - CASE WHEN v % 2 = 0 THEN sin(th) * coalesce(s, 0) ELSE 2 / pi() * (th + sin(th) * cos(th) * coalesce(s, 0)) END AS p FROM th LEFT JOIN sm USING (factor)) SELECT factor, {r('t')} AS t, {r('p')} AS p FROM p"""
add("ic_p_values", lambda s, d: st.with_p_values(st.ic_summary(st.daily_ic(long(s, d)))).select("factor", "t", "p").where("t IS NOT NULL"), P_SQL)


def _offsets(s, d):
    k = F.row_number().over(Window.partitionBy("factor").orderBy("date")) - 1
    per = st.daily_ic(long(s, d)).withColumn("offset", k % 5).groupBy("factor", "offset").agg(F.avg("rank_ic").alias("m"))
    return per.groupBy("factor").agg(F.percentile("m", F.lit(0.5)).alias("median"), F.min("m").alias("lo"), F.max("m").alias("hi"), F.avg((C("m") > 0).cast("double")).alias("positive"))


add("ic_nonoverlap", _offsets, f"WITH {BASE}, o AS (SELECT factor, (row_number() OVER (PARTITION BY factor ORDER BY date) - 1) % 5 AS k, rank_ic FROM ics), m AS (SELECT factor, k, avg(rank_ic) AS m FROM o GROUP BY 1, 2) SELECT factor, {r('quantile_cont(m, 0.5)')} AS median, {r('min(m)')} AS lo, {r('max(m)')} AS hi, {r('avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END)')} AS positive FROM m GROUP BY 1")
_g = lambda k: f"sum(e * l{k})"
add("ic_newey_west", lambda s, d: st.newey_west(st.daily_ic(long(s, d)), "rank_ic", "date", "factor", 4),
    f"WITH {BASE}, e AS (SELECT factor, date, rank_ic, rank_ic - avg(rank_ic) OVER (PARTITION BY factor) AS e FROM ics WHERE rank_ic IS NOT NULL), l AS (SELECT *, " + ", ".join(f"lag(e, {k}) OVER q AS l{k}" for k in range(1, 5)) + " FROM e WINDOW q AS (PARTITION BY factor ORDER BY date)), "
    f"v AS (SELECT factor, count(*) AS n, avg(rank_ic) AS mean, sqrt(greatest(0, sum(e * e) + " + " + ".join(f"2 * (1 - {k} / 5) * {_g(k)}" for k in range(1, 5)) + f")) / count(*) AS se FROM l GROUP BY 1) SELECT factor, n, {r('mean')} AS mean, {r('se')} AS se, {r('mean / se', 5)} AS t FROM v", {"t": 5})  # fmt: skip

# ---- quantiles: every fifth week, groups by momentum
QG = f"{BASE}, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM b)), gd AS (SELECT bs.* FROM bs JOIN cal USING (date) WHERE t % 5 = 0 AND mom20 IS NOT NULL), qq AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom20, symbol) AS k, count(*) OVER (PARTITION BY date) AS n FROM gd), qg AS (SELECT *, greatest(0, CAST(ceil((k - 1) * {{g}} / (n - 1)) AS INTEGER) - 1) AS grp FROM qq WHERE n >= 20)"


def _grid(s, d, groups=5):
    b = base(s, d)
    days = F.broadcast(calendar(b).where("t % 5 = 0").select("date"))
    return st.quantile_groups(b.join(days, "date"), "mom20", groups, 20)


def _group_returns(s, d):
    return _grid(s, d).groupBy("date", "grp").agg(F.count("y").alias("n"), F.avg("y").alias("ret"))


GR = QG.format(g=5) + ", gr AS (SELECT date, grp, count(y) AS n, avg(y) AS ret FROM qg GROUP BY 1, 2)"
add("quantile_groups", _group_returns, f"WITH {GR} SELECT date, grp, n, {r('ret')} AS ret FROM gr")


def _group_stats(s, d):
    g = _group_returns(s, d).where("ret IS NOT NULL")
    w = Window.partitionBy("grp").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    nav = g.withColumn("nav", F.exp(F.sum(F.log1p("ret")).over(w))).withColumn("peak", F.greatest(F.max("nav").over(w), F.lit(1.0)))
    return nav.groupBy("grp").agg(
        F.avg("ret").alias("mean"), (F.avg("ret") / (F.stddev_pop("ret") + 1e-12) * F.sqrt(F.lit(52 / 5))).alias("sharpe"),
        F.max(1 - C("nav") / C("peak")).alias("max_dd"), F.exp(F.sum(F.log1p("ret")) * (52 / 5) / F.count("*")).alias("annual"))


add("quantile_stats", _group_stats, f"WITH {GR}, nv AS (SELECT *, exp(sum(ln(1 + ret)) OVER q) AS nav FROM gr WHERE ret IS NOT NULL WINDOW q AS (PARTITION BY grp ORDER BY date)), pk AS (SELECT *, greatest(1, max(nav) OVER (PARTITION BY grp ORDER BY date)) AS peak FROM nv) SELECT grp, {r('avg(ret)')} AS mean, {r('avg(ret) / (stddev_pop(ret) + 1e-12) * sqrt(52 / 5)')} AS sharpe, {r('max(1 - nav / peak)')} AS max_dd, {r('exp(sum(ln(1 + ret)) * (52 / 5) / count(*))')} AS annual FROM pk GROUP BY 1")


def _jaccard(s, d):
    from tessera.operators.evaluation import overlap

    top = _grid(s, d).where("grp = 4").select("date", "symbol")
    dates = top.select("date").distinct().withColumn("t", F.row_number().over(Window.orderBy("date")))  # a calendar
    o = overlap(top.join(F.broadcast(dates), "date").select(F.lit(0).alias("one"), "symbol", "t"), ["one"]).where("was IS NOT NULL")
    return o.join(F.broadcast(dates), "t").select("date", (1 - C("both") / (C("n") + C("was") - C("both"))).alias("turnover"))


add("jaccard_turnover", _jaccard, f"WITH {QG.format(g=5)}, st AS (SELECT date, list(symbol) AS s FROM qg WHERE grp = 4 GROUP BY 1), lw AS (SELECT date, s, lag(s) OVER (ORDER BY date) AS p FROM st) SELECT date, {r('1 - len(list_intersect(s, p)) / len(list_distinct(list_concat(s, p)))')} AS turnover FROM lw WHERE p IS NOT NULL")


# ---- redundancy
def _pairs(s, d):
    i = st.daily_ic(long(s, d)).select("date", "factor", "rank_ic")
    j = i.select("date", C("factor").alias("other"), C("rank_ic").alias("o"))
    return i.join(j, "date").where("factor < other").groupBy("factor", "other").agg(st.correlation("rank_ic", "o").alias("corr"))


PAIRS = "pr AS (SELECT i.factor, j.factor AS other, covar_samp(i.rank_ic, j.rank_ic) / (stddev_samp(i.rank_ic) * stddev_samp(j.rank_ic)) AS corr FROM ics i JOIN ics j ON i.date = j.date AND i.factor < j.factor GROUP BY 1, 2)"
add("ic_correlation", _pairs, f"WITH {BASE}, {PAIRS} SELECT factor, other, {r('corr')} AS corr FROM pr")


def _prune(s, d):
    ic = st.daily_ic(long(s, d))
    score = {x.factor: x["mean"] for x in st.ic_summary(ic).collect()}
    corr = {(x.factor, x.other): x["corr"] for x in _pairs(s, d).collect()}
    return s.createDataFrame(st.greedy_prune(list(score), score, corr, 0.3), "factor string, kept boolean, match string, corr double")


add("greedy_prune", _prune, f"""WITH RECURSIVE {BASE}, {PAIRS}, i AS (SELECT factor, row_number() OVER (ORDER BY avg(rank_ic) DESC, factor) AS k FROM ics GROUP BY 1), l AS (SELECT factor, list({{'o': other, 'c': corr}}) AS l FROM (SELECT factor, other, corr FROM pr UNION ALL SELECT other, factor, corr FROM pr) GROUP BY 1), o AS (SELECT i.k, i.factor, l.l FROM i LEFT JOIN l USING (factor)),
  w AS (SELECT CAST(0 AS BIGINT) AS k, CAST('' AS VARCHAR) AS factor, CAST([] AS VARCHAR[]) AS kept, true AS ok, CAST(NULL AS VARCHAR) AS match, CAST(NULL AS DOUBLE) AS corr
    UNION ALL SELECT z.k, z.factor, CASE WHEN coalesce(top.c <= 0.3, true) THEN list_append(z.kept, z.factor) ELSE z.kept END, coalesce(top.c <= 0.3, true), top.o, top.c FROM (SELECT o.k, o.factor, w.kept, list_sort(list_transform(list_filter(o.l, lambda x: list_contains(w.kept, x.o) AND x.c IS NOT NULL), lambda x: {{'c': x.c, 'o': x.o}}), 'DESC')[1] AS top FROM w JOIN o ON o.k = w.k + 1) z)
  SELECT factor, ok AS kept, match, {r('corr')} AS corr FROM w WHERE k > 0""")


def _partial(s, d):
    """Correlation of vol10 with the label given mom20, on ranks of jointly complete rows."""
    b = base(s, d).where("vol10 IS NOT NULL AND mom20 IS NOT NULL AND y IS NOT NULL")
    for k in ("vol10", "mom20", "y"):
        b = b.withColumn(f"r_{k}", st.average_rank(C(k), "date"))
    g = b.groupBy("date").agg(F.count("*").alias("n"), *[st.correlation(f"r_{x}", f"r_{y}").alias(k) for k, x, y in (("cl", "vol10", "y"), ("cf", "vol10", "mom20"), ("lf", "y", "mom20"))])
    den = F.sqrt((1 - C("cf") ** 2) * (1 - C("lf") ** 2))
    return g.where("n >= 30").select("date", "n", F.try_divide(C("cl") - C("cf") * C("lf"), F.nullif(den, F.lit(0.0))).alias("partial"))


_rk = lambda x: f"rank() OVER (PARTITION BY date ORDER BY {x}) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2 AS r_{x}"
_co = lambda x, y: f"covar_samp(r_{x}, r_{y}) / (stddev_samp(r_{x}) * stddev_samp(r_{y}))"
add("partial_rank_ic", _partial, f"WITH {BASE}, j AS (SELECT date, {_rk('vol10')}, {_rk('mom20')}, {_rk('y')} FROM bs WHERE vol10 IS NOT NULL AND mom20 IS NOT NULL AND y IS NOT NULL), c AS (SELECT date, count(*) AS n, {_co('vol10', 'y')} AS cl, {_co('vol10', 'mom20')} AS cf, {_co('y', 'mom20')} AS lf FROM j GROUP BY 1 HAVING count(*) >= 30) SELECT date, n, {r('(cl - cf * lf) / sqrt((1 - cf * cf) * (1 - lf * lf))')} AS partial FROM c")


def _eta(s, d):
    b = base(s, d).where("mom20 IS NOT NULL").join(meta(s, d).select("symbol", "sector"), "symbol")
    b = b.withColumn("k", st.average_rank(C("mom20"), "date"))
    day, cell = Window.partitionBy("date"), Window.partitionBy("date", "sector")
    b = b.withColumn("m", F.avg("k").over(day)).withColumn("c", F.avg("k").over(cell))
    return b.groupBy("date").agg(F.try_divide(F.sum((C("c") - C("m")) ** 2), F.nullif(F.sum((C("k") - C("m")) ** 2), F.lit(0.0))).alias("eta2"))


add("industry_eta2", _eta, f"WITH {BASE}, {META}, k AS (SELECT date, sector, {_rk('mom20').replace('r_mom20', 'k')} FROM bs JOIN meta USING (symbol) WHERE mom20 IS NOT NULL), e AS (SELECT *, avg(k) OVER (PARTITION BY date) AS m, avg(k) OVER (PARTITION BY date, sector) AS c FROM k) SELECT date, {r('sum((c - m) * (c - m)) / nullif(sum((k - m) * (k - m)), 0)')} AS eta2 FROM e GROUP BY 1")
QS = (0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)


def _profile(s, d):
    """Quantiles and shares outside ten deviations of each factor; a row a factor comes from the driver."""
    kept = base(s, d).select(*FACTORS).persist(StorageLevel.DISK_ONLY)
    x = st.unpivot(kept, [], list(FACTORS), []).where("x IS NOT NULL")
    q = st.narrowed_quantiles(x, "x", "factor", QS)
    small = lambda rows, cols: F.broadcast(s.createDataFrame(rows, f"factor string, {cols}"))
    dev = x.join(small([(f, v[5]) for f, (_, v) in q.items()], "m double"), "factor").select("factor", F.abs(C("x") - C("m")).alias("dev"))
    mad = {f: v[0] for f, (_, v) in st.narrowed_quantiles(dev, "dev", "factor", (0.5,)).items()}
    far = dev.join(small(list(mad.items()), "mad double"), "factor").groupBy("factor").agg(F.avg((C("dev") > 10 * C("mad")).cast("double")).alias("outside"))
    out = {g.factor: g.outside for g in far.collect()}
    kept.unpersist()
    rows = [(f, n, *v, mad[f], out[f]) for f, (n, v) in q.items()]
    return s.createDataFrame(rows, "factor string, n long, " + ", ".join(f"q{k} double" for k in range(len(QS))) + ", mad double, outside double")


add("distribution_profile", _profile, f"WITH {BASE}, x AS (SELECT factor, x FROM lg WHERE x IS NOT NULL), q AS (SELECT factor, count(*) AS n, quantile_cont(x, {list(QS)}) AS q FROM x GROUP BY 1), v AS (SELECT factor, x, abs(x - q[6]) AS dev FROM x JOIN q USING (factor)), m AS (SELECT factor, quantile_cont(dev, 0.5) AS mad FROM v GROUP BY 1), o AS (SELECT factor, avg(CASE WHEN dev > 10 * mad THEN 1.0 ELSE 0.0 END) AS outside FROM v JOIN m USING (factor) GROUP BY 1) SELECT factor, n, " + ", ".join(f"{r(f'q[{k + 1}]')} AS q{k}" for k in range(len(QS))) + f", {r('mad')} AS mad, {r('outside')} AS outside FROM q JOIN m USING (factor) JOIN o USING (factor)")


def _thirds(s, d):
    ic = st.daily_ic(long(s, d))
    n = F.count("*").over(Window.partitionBy("factor"))
    k = F.row_number().over(Window.partitionBy("factor").orderBy("date"))
    ic = ic.withColumn("part", F.least(F.floor((k - 1) * 3 / n), F.lit(2)))
    m = [F.avg(F.when(C("part") == i, C("rank_ic"))).alias(f"m{i}") for i in range(3)]
    g = ic.groupBy("factor").agg(*m, F.avg((C("rank_ic") > 0).cast("double")).alias("positive"))
    sign = F.when(C("m0") >= 0, 1.0).otherwise(-1.0)
    score = 0.4 * F.abs("m0") + 0.25 * sign * C("m1") + 0.2 * sign * C("m2") + 0.15 * F.abs(C("positive") - 0.5)
    return g.select("factor", "m0", "m1", "m2", "positive", F.try_divide(sign * C("m2"), F.nullif(F.abs("m0"), F.lit(0.0))).alias("retention"), score.alias("score"))


SIGN = "(CASE WHEN m0 >= 0 THEN 1.0 ELSE -1.0 END)"
add("stability_score", _thirds, f"WITH {BASE}, k AS (SELECT factor, rank_ic, least(floor((row_number() OVER (PARTITION BY factor ORDER BY date) - 1) * 3 / count(*) OVER (PARTITION BY factor)), 2) AS part FROM ics), g AS (SELECT factor, avg(rank_ic) FILTER (part = 0) AS m0, avg(rank_ic) FILTER (part = 1) AS m1, avg(rank_ic) FILTER (part = 2) AS m2, avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END) AS positive FROM k GROUP BY 1) SELECT factor, {r('m0')} AS m0, {r('m1')} AS m1, {r('m2')} AS m2, {r('positive')} AS positive, {r(f'{SIGN} * m2 / nullif(abs(m0), 0)')} AS retention, {r(f'0.4 * abs(m0) + 0.25 * {SIGN} * m1 + 0.2 * {SIGN} * m2 + 0.15 * abs(positive - 0.5)')} AS score FROM g")


def _gates(s, d):
    miss = long(s, d).groupBy("factor").agg(F.avg(C("x").isNull().cast("double")).alias("missing"))
    ic = st.ic_summary(st.daily_ic(long(s, d))).select("factor", "mean")
    red = _pairs(s, d)
    top = red.select("factor", "corr").unionByName(red.select(C("other").alias("factor"), "corr")).groupBy("factor").agg(F.max(F.abs("corr")).alias("top"))
    g = miss.join(ic, "factor").join(top, "factor", "left")
    why = F.when(C("missing") > 0.15, "missing").when(F.abs("mean") < 0.01, "weak").when(C("top") >= 0.7, "redundant").otherwise("admitted")
    return g.select("factor", "missing", "mean", "top", why.alias("decision"))


add("admission_gates", _gates, f"WITH {BASE}, {PAIRS}, m AS (SELECT factor, avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END) AS missing FROM lg GROUP BY 1), i AS (SELECT factor, avg(rank_ic) AS mean FROM ics GROUP BY 1), t AS (SELECT factor, max(abs(corr)) AS top FROM (SELECT factor, corr FROM pr UNION ALL SELECT other, corr FROM pr) GROUP BY 1) SELECT factor, {r('missing')} AS missing, {r('mean')} AS mean, {r('top')} AS top, CASE WHEN missing > 0.15 THEN 'missing' WHEN abs(mean) < 0.01 THEN 'weak' WHEN top >= 0.7 THEN 'redundant' ELSE 'admitted' END AS decision FROM m JOIN i USING (factor) LEFT JOIN t USING (factor)")
add("bh_fdr", lambda s, d: st.benjamini_hochberg(st.daily_ic(long(s, d)).groupBy("date").agg(F.least(F.abs(F.avg("rank_ic")), F.lit(1.0)).alias("p")).withColumn("p", F.round("p", 9)).withColumn("key", C("date").cast("string")), "p", "key").select("date", "p", "q"),
    f"WITH {BASE}, p AS (SELECT date, round(least(abs(avg(rank_ic)), 1), 9) AS p FROM ics GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY p, date) AS k, count(*) OVER () AS m FROM p) SELECT date, {r('p')} AS p, {r('least(1, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING))')} AS q FROM k")


def _strata(s, d):
    """Mean rank IC by year and by all years, as grouping sets."""
    ic = st.daily_ic(long(s, d)).withColumn("year", F.year("date"))
    return ic.rollup("factor", "year").agg(F.count("*").alias("days"), F.avg("rank_ic").alias("mean")).where("factor IS NOT NULL")


add("ic_by_year", _strata, f"WITH {BASE} SELECT factor, CAST(year(date) AS INTEGER) AS year, count(*) AS days, {r('avg(rank_ic)')} AS mean FROM ics GROUP BY GROUPING SETS ((factor, year(date)), (factor))")
