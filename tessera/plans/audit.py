"""Queries for audits, segments, concentration and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import crosssection as cs
from tessera.operators import models
from tessera.operators import statistics as st
from tessera.panel import Panel, bars, calendar, meta, table, with_gaps
from tessera.plans.base import GAPS, META, WEEKS, add, r
from tessera.plans.operators import M_SQL, WINS, fwl
from tessera.plans.statistics import BASE, FACTORS, base, long

C = F.col


def _audit(s, d):
    """Rows, share of nulls, distinct dates and symbols, first and last date of bars with gaps."""
    b = with_gaps(bars(s, d))
    return b.agg(F.count("*").alias("n"), F.avg(C("close").isNull().cast("double")).alias("missing"), F.countDistinct("symbol").alias("symbols"), F.countDistinct("date").alias("dates"), F.min("date").alias("lo"), F.max("date").alias("hi"))


add("coverage_audit", _audit, f"WITH {WEEKS}, {GAPS} SELECT count(*) AS n, {r('avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing, count(DISTINCT symbol) AS symbols, count(DISTINCT date) AS dates, min(date) AS lo, max(date) AS hi FROM g")


def _reasons(s, d):
    p = Panel(with_gaps(bars(s, d)))
    k = p.let(F.row_number().over(p.order()))
    why = F.when(C("close").isNull(), "gap").when(k <= 20, "warm_up").otherwise("present")
    return p.df.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


add("missing_reasons", _reasons, f"WITH {WEEKS}, {GAPS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM g) SELECT CASE WHEN close IS NULL THEN 'gap' WHEN k <= 20 THEN 'warm_up' ELSE 'present' END AS reason, count(*) AS n FROM k GROUP BY 1")


def _pooled(s, d):
    """Spearman between factors over all complete rows of the panel, by ranks from counts of distinct values."""
    b = base(s, d).where("rev5 IS NOT NULL AND mom20 IS NOT NULL AND vol10 IS NOT NULL")
    ranked = None
    for f in FACTORS:
        # average rank = rows below + (ties + 1) / 2
        v = st.value_runs(b, f, []).select(f, (C("before") + (C("c") + 1) / 2).alias(f"r_{f}"))
        ranked = b.join(v, f) if ranked is None else ranked.join(v, f)
    pairs = [("rev5", "mom20"), ("rev5", "vol10"), ("mom20", "vol10")]
    return ranked.agg(*[st.correlation(f"r_{x}", f"r_{y}").alias(f"{x}_{y}") for x, y in pairs])


_co = lambda x, y: f"covar_samp(r_{x}, r_{y}) / (stddev_samp(r_{x}) * stddev_samp(r_{y}))"
add("pooled_spearman", _pooled, f"WITH {BASE}, k AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2 AS r_{f}" for f in FACTORS) + f" FROM bs WHERE rev5 IS NOT NULL AND mom20 IS NOT NULL AND vol10 IS NOT NULL) SELECT {r(_co('rev5', 'mom20'))} AS rev5_mom20, {r(_co('rev5', 'vol10'))} AS rev5_vol10, {r(_co('mom20', 'vol10'))} AS mom20_vol10 FROM k")


def _tails(s, d):
    """Mean label of the upper and the lower tenth by factor and date, as shares of ranks."""
    ok = long(s, d).where("x IS NOT NULL AND y IS NOT NULL")
    pct = st.average_rank(C("x"), "date", "factor") / F.count("*").over(Window.partitionBy("date", "factor"))
    return ok.withColumn("k", pct).groupBy("date", "factor").agg(F.avg(F.when(C("k") > 0.9, C("y"))).alias("top"), F.avg(F.when(C("k") <= 0.1, C("y"))).alias("bottom"))


add("tail_means", _tails, f"WITH {BASE}, k AS (SELECT *, rx / count(*) OVER (PARTITION BY date, factor) AS k FROM ok) SELECT date, factor, {r('avg(y) FILTER (k > 0.9)')} AS top, {r('avg(y) FILTER (k <= 0.1)')} AS bottom FROM k GROUP BY 1, 2")


def _concentration(s, d):
    """Herfindahl index and normalised entropy of symbols over industries."""
    g = meta(s, d).groupBy("industry").agg(F.count("*").alias("n"))
    g = g.withColumn("p", C("n") / F.sum("n").over(Window.partitionBy()))
    return g.agg(F.sum(C("p") * C("p")).alias("hhi"), (-F.sum(C("p") * F.log("p")) / F.log(F.count("*"))).alias("entropy"))


add("category_concentration", _concentration, f"WITH {META}, g AS (SELECT count(*) AS n FROM meta GROUP BY industry), p AS (SELECT n / sum(n) OVER () AS p FROM g) SELECT {r('sum(p * p)')} AS hhi, {r('-sum(p * ln(p)) / ln(count(*))')} AS entropy FROM p")


def _wins(s, d):
    """Years in which mom20 has the higher mean rank IC than vol10."""
    y = st.daily_ic(long(s, d)).groupBy(F.year("date").alias("year")).agg(*[F.avg(F.when(C("factor") == f, C("rank_ic"))).alias(f) for f in ("mom20", "vol10")])
    return y.select("year", "mom20", "vol10", (C("mom20") > C("vol10")).alias("wins"))


add("yearly_wins", _wins, f"WITH {BASE}, y AS (SELECT CAST(year(date) AS INTEGER) AS year, avg(rank_ic) FILTER (factor = 'mom20') AS m, avg(rank_ic) FILTER (factor = 'vol10') AS v FROM ics GROUP BY 1) SELECT year, {r('m')} AS mom20, {r('v')} AS vol10, m > v AS wins FROM y")


def _segments(s, d):
    """Rows by split and by whether they may train: the bar doesn't touch its weekly limit."""
    seg = F.when(C("date").between(F.lit("1996-01-01"), F.lit("1996-12-31")), "valid").when(C("date") >= F.lit("1997-01-01"), "test").otherwise("other")
    ok = F.coalesce(C("high") > C("low"), F.lit(False))
    return bars(s, d).groupBy(seg.alias("segment"), ok.alias("trainable")).agg(F.count("*").alias("n"))


add("segments", _segments, f"WITH {WEEKS} SELECT CASE WHEN date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' THEN 'valid' WHEN date >= DATE '1997-01-01' THEN 'test' ELSE 'other' END AS segment, high > low AS trainable, count(*) AS n FROM b GROUP BY 1, 2")


def _codes(s, d):
    """Symbols between the forms 000012.SH and SH000012, and their exchange."""
    ex = F.when(C("s_suppkey") % 2 == 0, "SH").otherwise("SZ")
    code = F.format_string("%06d.%s", "s_suppkey", ex)
    df = table(s, d, "supplier").select("s_suppkey", code.alias("code"))
    pre = F.regexp_replace("code", r"^(\d{6})\.([A-Z]{2})$", "$2$1")
    return df.select("s_suppkey", "code", pre.alias("prefixed"), F.coalesce(F.nullif(F.regexp_extract(pre, "^([A-Z]{2})", 1), F.lit("")), F.lit("?")).alias("exchange"))


add("symbol_codes", _codes, r"WITH c AS (SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.' || CASE WHEN s_suppkey % 2 = 0 THEN 'SH' ELSE 'SZ' END AS code FROM supplier) SELECT s_suppkey, code, substr(code, 8) || substr(code, 1, 6) AS prefixed, substr(code, 8) AS exchange FROM c")


def _tercile(s, d):
    """Size terciles of each date by linear quantile cuts, right-closed."""
    p = Panel(bars(s, d).join(meta(s, d).select("symbol", "size"), "symbol"))
    q = p.let(F.percentile("size", F.array(F.lit(1 / 3), F.lit(2 / 3))).over(p.day()))
    return p.df.groupBy("date", F.when(C("size") <= q[0], 0).when(C("size") <= q[1], 1).otherwise(2).alias("tercile")).agg(F.count("*").alias("n"), F.avg("close").alias("close"))


add("size_tercile", _tercile, f"WITH {WEEKS}, {META}, q AS (SELECT b.*, size, quantile_cont(size, 1 / 3) OVER (PARTITION BY date) AS a, quantile_cont(size, 2 / 3) OVER (PARTITION BY date) AS c FROM b JOIN meta USING (symbol)) SELECT date, CASE WHEN size <= a THEN 0 WHEN size <= c THEN 1 ELSE 2 END AS tercile, count(*) AS n, {r('avg(close)', 4)} AS close FROM q GROUP BY 1, 2", 4)


def _sets(s, d):
    """Customers with orders in 1995 but not in 1996, and in both: anti and semi joins."""
    o = table(s, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    a, b = (o.where(C("y") == y).select("o_custkey").distinct() for y in (1995, 1996))
    return a.join(b, "o_custkey", "left_anti").withColumn("kind", F.lit("left")).unionByName(a.join(b, "o_custkey", "left_semi").withColumn("kind", F.lit("both")))


add("set_operations", _sets, "WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1995), b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996) SELECT o_custkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM b) THEN 'both' ELSE 'left' END AS kind FROM a")
add("sample_rows", lambda s, d: bars(s, d).select("symbol", "date", F.md5(F.concat_ws("|", C("symbol").cast("string"), C("date").cast("string"), F.lit("7"))).alias("h")).orderBy("h").limit(500).select("symbol", "date"),
    f"WITH {WEEKS} SELECT symbol, date FROM b ORDER BY md5(CAST(symbol AS VARCHAR) || '|' || CAST(date AS VARCHAR) || '|7') LIMIT 500")


def _candidate(s, d):
    """Winsorised z-score, then its residual on [1, log size], standardised."""
    p = Panel(with_gaps(bars(s, d)).join(meta(s, d), "symbol"))
    z = cs.zscore(p, cs.winsorize(p, C("close")))
    return p.select(z=z, score=cs.zscore(p, cs.size_residual(p, z, p.let(F.log("size")))))


add("candidate_score", _candidate, M_SQL + f"wz AS (SELECT *, {WINS.format(x='close')} AS cw FROM m WINDOW d AS (PARTITION BY date)), zz AS (SELECT *, CASE WHEN stddev_samp(cw) OVER d > 1e-12 THEN (cw - avg(cw) OVER d) / stddev_samp(cw) OVER d END AS z FROM wz WINDOW d AS (PARTITION BY date)), " + fwl("z", "1", True, 30, False, "zz") + f" SELECT symbol, date, {r('z', 5)} AS z, {r('CASE WHEN stddev_samp(nt_v) OVER d > 1e-12 THEN (nt_v - avg(nt_v) OVER d) / stddev_samp(nt_v) OVER d END', 5)} AS score FROM nt WINDOW d AS (PARTITION BY date)", 5)


def _robust(s, d):
    """Mean label of the upper fifth by rebalance frequency and offset: median, worst and share of gains."""
    b = base(s, d).where("mom20 IS NOT NULL AND y IS NOT NULL")
    k = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("mom20"), "symbol"))
    top = b.withColumn("k", k).withColumn("n", F.count("*").over(Window.partitionBy("date"))).where("k <= n / 5").groupBy("date").agg(F.avg("y").alias("ret"))
    grid = top.join(F.broadcast(calendar(base(s, d))), "date").withColumn("every", F.explode(F.array(*[F.lit(x) for x in (5, 10, 20)])))
    per = grid.groupBy("every", F.pmod("t", "every").alias("offset")).agg(F.avg("ret").alias("m"))
    return per.groupBy("every").agg(F.percentile("m", F.lit(0.5)).alias("median"), F.min("m").alias("worst"), F.avg((C("m") > 0).cast("double")).alias("positive"))


add("frequency_robustness", _robust, f"WITH {BASE}, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM b)), k AS (SELECT date, y, row_number() OVER (PARTITION BY date ORDER BY mom20 DESC, symbol) AS k, count(*) OVER (PARTITION BY date) AS n FROM bs WHERE mom20 IS NOT NULL AND y IS NOT NULL), tp AS (SELECT date, avg(y) AS ret FROM k WHERE k <= n / 5 GROUP BY 1), p AS (SELECT e AS every, t % e AS o, avg(ret) AS m FROM tp JOIN cal USING (date), (VALUES (5), (10), (20)) v(e) GROUP BY 1, 2) SELECT every, {r('quantile_cont(m, 0.5)')} AS median, {r('min(m)')} AS worst, {r('avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END)')} AS positive FROM p GROUP BY 1")


def _covariance(s, d):
    """Shrunk covariance of sectors' weekly returns: (row, column, value), and minimum-variance weights."""
    nav = bars(s, d).join(meta(s, d).select("symbol", "sector"), "symbol").groupBy("sector", "date").agg(F.avg("close").alias("nav"))
    ret = nav.withColumn("ret", F.log("nav") - F.log(F.lag("nav").over(Window.partitionBy("sector").orderBy("date")))).where("ret IS NOT NULL")
    return models.minimum_variance(models.shrunk_covariance(ret, "sector", "date", "ret", 52.0))


add("covariance_weights", _covariance, None, 4)
COV = f"""{META}, nv AS (SELECT sector, date, avg(close) AS nav FROM b JOIN meta USING (symbol) GROUP BY 1, 2), rr AS (SELECT sector AS i, date AS t, ln(nav) - ln(lag(nav) OVER (PARTITION BY sector ORDER BY date)) AS v FROM nv), rt2 AS (SELECT * FROM rr WHERE v IS NOT NULL), md AS (SELECT i, quantile_cont(v, 0.5) AS mid FROM rt2 GROUP BY 1),
  gr AS (SELECT md.i, t.t, coalesce(v, mid) AS v FROM md, (SELECT DISTINCT t FROM rt2) t LEFT JOIN rt2 ON rt2.i = md.i AND rt2.t = t.t), ce AS (SELECT i, t, v - avg(v) OVER (PARTITION BY i) AS a FROM gr),
  mm AS (SELECT x.i, y.i AS j, count(*) AS n, avg(x.a * y.a) AS s, avg(x.a * x.a * y.a * y.a) AS q, CASE WHEN x.i = y.i THEN 1.0 ELSE 0.0 END AS same FROM ce x JOIN ce y ON x.t = y.t GROUP BY 1, 2), mu AS (SELECT *, sqrt(count(*) OVER ()) AS k, sum(s * same) OVER () / sqrt(count(*) OVER ()) AS mu FROM mm),
  dd AS (SELECT *, sum((s - mu * same) * (s - mu * same)) OVER () / k AS d2, sum(q - s * s) OVER () / (n * k) AS b2 FROM mu), sh AS (SELECT *, CASE WHEN d2 > 0 THEN least(b2, d2) / d2 ELSE 1 END AS w FROM dd)"""
add("shrunk_covariance", lambda s, d: _covariance(s, d).select("name", "other", "covariance"), f"WITH {WEEKS}, {COV} SELECT i AS name, j AS other, {r('52 * CASE WHEN n < 40 THEN s * same ELSE w * mu * same + (1 - w) * s END')} AS covariance FROM sh")


def _mlp(s, d):
    b = base(s, d)
    dates = [x.date for x in calendar(b).select("date").orderBy("date").collect()]
    return models.rolling_predict(b, list(FACTORS), "y", models.walk_forward(dates, 200, 30, 50, 5), "mlp")


add("mlp", _mlp, None, 4)
