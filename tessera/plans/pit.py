"""Queries for point-in-time joins, cleaning and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import joins
from tessera.panel import Panel, bars, table, with_gaps
from tessera.plans.base import GAPS, WEEKS, add, r
from tessera.sources import documents as docs

C = F.col


def events(s, d) -> DataFrame:
    """Announcements: one per order; the period is the quarter before it."""
    day = C("o_orderdate").cast("date")
    return table(s, d, "orders").select(C("o_custkey").alias("symbol"), day.alias("ann_date"), F.date_sub(F.date_trunc("quarter", day).cast("date"), 1).alias("report_period"), C("o_totalprice").alias("value"), C("o_orderkey").alias("id"))


EV = "ev AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS ann_date, CAST(date_trunc('quarter', o_orderdate) AS DATE) - 1 AS report_period, o_totalprice AS value, o_orderkey AS id FROM orders)"
PIT = EV + """, dy AS (SELECT * FROM ev WHERE ann_date >= report_period QUALIFY row_number() OVER (PARTITION BY symbol, ann_date ORDER BY report_period DESC, id DESC) = 1),
kn AS (SELECT * FROM dy QUALIFY report_period = max(report_period) OVER (PARTITION BY symbol ORDER BY ann_date ROWS UNBOUNDED PRECEDING)),
pit AS (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY report_period) - 1 AS report_seq FROM kn)"""
GRID = "grid AS (SELECT c_custkey AS symbol, m AS date FROM customer, (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders))"


def pit(s, d):
    return joins.pit_events(events(s, d), "symbol", "ann_date", "report_period", ("id",))


def grid(s, d):
    """Customers by month, from the first order's to the last's."""
    lo, hi = table(s, d, "orders").agg(*[f("o_orderdate") for f in (F.min, F.max)]).first()
    months = F.sequence(*[F.date_trunc("month", F.lit(x)).cast("date") for x in (lo, hi)], F.expr("INTERVAL 1 MONTH"))
    return table(s, d, "customer").select(C("c_custkey").alias("symbol"), F.explode(months).alias("date"))


add("pit_events", pit, f"WITH {PIT} SELECT symbol, ann_date, report_period, {r('value')} AS value, id, report_seq FROM pit")


def _asof(s, d):
    return joins.as_of(grid(s, d), pit(s, d), "symbol", "date", "ann_date").select("symbol", "date", "ann_date", "report_period", "value")


add("asof_merge", _asof, f"WITH {PIT}, {GRID} SELECT g.symbol, g.date, p.ann_date, p.report_period, {r('p.value')} AS value FROM grid g ASOF LEFT JOIN pit p ON g.symbol = p.symbol AND g.date >= p.ann_date")
RUNS = "runs AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS start_date, lead(CAST(o_orderdate AS DATE)) OVER q AS end_date, o_orderpriority AS attribute, o_orderstatus AS status FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) = 1) WINDOW q AS (PARTITION BY o_custkey ORDER BY o_orderdate))"


def runs(s, d):
    from pyspark.sql.window import Window

    o = table(s, d, "orders").withColumn("start_date", C("o_orderdate").cast("date"))
    o = joins.first_of(o, ["o_custkey", "start_date"], [C("o_orderkey")])
    w = Window.partitionBy("o_custkey").orderBy("start_date")
    return o.select(C("o_custkey").alias("symbol"), "start_date", F.lead("start_date").over(w).alias("end_date"), C("o_orderpriority").alias("attribute"), C("o_orderstatus").alias("status"))


# intervals of some customers end early, so that time stands outside of any
_early = lambda c: F.when(C("symbol") % 3 == 0, F.date_add("start_date", 30)).otherwise(C(c))
EARLY = "CASE WHEN symbol % 3 = 0 THEN start_date + 30 ELSE end_date END AS end_date"
add("interval_attach", lambda s, d: joins.as_of_valid(grid(s, d), runs(s, d).drop("status").withColumn("end_date", _early("end_date")), "symbol", "date", "start_date", "end_date").select("symbol", "date", "attribute"),
    f"WITH {RUNS}, iv AS (SELECT * REPLACE ({EARLY.replace(' AS end_date', '')} AS end_date) FROM runs), {GRID} SELECT g.symbol, g.date, CASE WHEN i.end_date IS NULL OR g.date < i.end_date THEN i.attribute END AS attribute FROM grid g ASOF LEFT JOIN iv i ON g.symbol = i.symbol AND g.date >= i.start_date")


def _names(s, d):
    named = joins.as_of_valid(grid(s, d), runs(s, d).drop("attribute").withColumn("end_date", F.date_sub("end_date", 1)), "symbol", "date", "start_date", "end_date", closed=True)
    return named.where(~F.coalesce(C("status").rlike("(?i)f|x"), F.lit(False))).select("symbol", "date", "status")


add("pit_name_filter", _names, f"WITH {RUNS}, {GRID} SELECT * FROM (SELECT g.symbol, g.date, CASE WHEN i.end_date IS NULL OR g.date <= i.end_date - 1 THEN i.status END AS status FROM grid g ASOF LEFT JOIN runs i ON g.symbol = i.symbol AND g.date >= i.start_date) WHERE NOT coalesce(regexp_matches(status, '(?i)f|x'), false)")
add("interval_overlap", lambda s, d: joins.overlaps(runs(s, d).withColumn("end_date", F.date_add("start_date", 90)), "symbol", "start_date", "end_date").select("symbol", "start_date", "end_date", "previous_end"),
    f"WITH {RUNS}, iv AS (SELECT symbol, start_date, start_date + 90 AS end_date FROM runs) SELECT symbol, start_date, end_date, p AS previous_end FROM (SELECT *, lag(end_date) OVER (PARTITION BY symbol ORDER BY start_date, end_date) AS p FROM iv) WHERE p > start_date")


def _reports(s, d):
    p = Panel(joins.as_of(grid(s, d), pit(s, d), "symbol", "date", "ann_date").select("symbol", "date", "report_period", "value"))
    return p


LAGS = f"""WITH {PIT}, {GRID}, daily AS (SELECT g.symbol, g.date, p.report_period, p.report_seq AS seq, p.value FROM grid g ASOF LEFT JOIN pit p ON g.symbol = p.symbol AND g.date >= p.ann_date),
sq AS (SELECT *, CASE WHEN report_period IS NOT NULL THEN dense_rank() OVER (PARTITION BY symbol ORDER BY report_period NULLS LAST) END AS k FROM daily),
fin AS (SELECT symbol, k, arg_max(value, date) AS v FROM sq WHERE k IS NOT NULL GROUP BY 1, 2)
SELECT sq.symbol, sq.date, {{col}} AS v FROM sq LEFT JOIN fin ON fin.symbol = sq.symbol AND fin.k = sq.k - {{n}}"""


def _lag(s, d):
    p = _reports(s, d)
    return p.select(v=joins.report_lag(p, C("value"), 2))


def _delta(s, d):
    p = _reports(s, d)
    return p.select(v=joins.report_delta(p, C("value"), 1))


add("fin_lag_report", _lag, LAGS.format(col=r("fin.v"), n=2))
add("fin_delta_report", _delta, LAGS.format(col=r("sq.value - fin.v"), n=1))
add("upsert_latest", lambda s, d: joins.upsert(events(s, d).where("id % 3 <> 0"), events(s, d).where("id % 2 = 0").withColumn("value", C("value") + 1), ["symbol", "report_period"], [F.desc("ann_date"), F.desc("id"), F.desc("value")]).select("symbol", "report_period", "ann_date", "value", "id"),
    f"WITH {EV}, al AS (SELECT * FROM ev WHERE id % 3 <> 0 UNION ALL SELECT symbol, ann_date, report_period, value + 1, id FROM ev WHERE id % 2 = 0) SELECT symbol, report_period, ann_date, {r('value')} AS value, id FROM al QUALIFY row_number() OVER (PARTITION BY symbol, report_period ORDER BY ann_date DESC, id DESC, value DESC) = 1")
add("ffill_panel", lambda s, d: joins.forward_fill(Panel(with_gaps(bars(s, d))), "close").df.select("symbol", "date", "close"),
    f"WITH {WEEKS}, {GAPS} SELECT symbol, date, {r('last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)')} AS close FROM g")
add("dedup_first", lambda s, d: joins.first_of(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), ["l_orderkey", "l_linenumber"], [C("l_partkey"), C("l_extendedprice")]),
    f"SELECT l_orderkey, l_linenumber, l_partkey, {r('l_extendedprice')} AS l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_extendedprice) = 1")


def _listed(s, d):
    b = bars(s, d)
    first = b.groupBy("symbol").agg(F.min("date").alias("list_date")).withColumn("list_date", F.when(C("symbol") % 10 != 0, C("list_date")))
    return b.join(first, "symbol").where(F.datediff("date", "list_date") >= 60).select("symbol", "date", "close")


add("new_listing_filter", _listed, f"WITH {WEEKS}, li AS (SELECT symbol, CASE WHEN symbol % 10 <> 0 THEN min(date) END AS list_date FROM b GROUP BY symbol) SELECT symbol, date, {r('close')} AS close FROM b JOIN li USING (symbol) WHERE date_diff('day', list_date, date) >= 60")
add("index_code_filter", lambda s, d: docs.exclude_prefixes(table(s, d, "customer").select("c_custkey", C("c_custkey").cast("string").alias("code")), "code", ["1", "33"]),
    "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS code FROM customer WHERE NOT (CAST(c_custkey AS VARCHAR) LIKE '1%' OR CAST(c_custkey AS VARCHAR) LIKE '33%')")
add("pit_contract_violations", lambda s, d: joins.as_of(grid(s, d), pit(s, d), "symbol", "date", "ann_date").select("symbol", "date", "ann_date", F.date_add("date", 1).alias("executed"), F.date_add("date", F.pmod("symbol", F.lit(3)).cast("int")).alias("label_end")).where("NOT (coalesce(ann_date, date) <= date AND date < executed AND executed < label_end)").groupBy("symbol").agg(F.count("*").alias("violations")),
    f"WITH {GRID} SELECT symbol, count(*) AS violations FROM grid WHERE NOT (date + 1 < date + CAST(symbol % 3 AS INTEGER)) GROUP BY symbol")

# ---- documents
ID = "sha256(source || '|' || CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE sha256(norm) END)"
add("doc_identity_dedup", lambda s, d: docs.dedup_documents(docs.identified(table(s, d, "documents").select("doc_id", "source", F.when(C("doc_id") % 2 == 0, C("doc_id").cast("string")).alias("external_id"), F.lit(None).cast("string").alias("source_url"), C("text").alias("content"))), [C("doc_id")]).select("doc_id", "document_id", "content_hash"),
    rf"WITH n AS (SELECT *, trim(regexp_replace(replace(text, chr(0), ''), '[ \t\n\r\f\v]+', ' ', 'g')) AS norm FROM documents) SELECT doc_id, {ID} AS document_id, sha256(norm) AS content_hash FROM n QUALIFY row_number() OVER (PARTITION BY source, sha256(norm) ORDER BY doc_id) = 1")
add("html_strip", lambda s, d: table(s, d, "pages").select("page_id", docs.strip_html(C("html")).alias("text")),
    r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r\f\v]+', ' ', 'g')) AS text FROM pages".replace('\\"', '"'))
