"""How queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.panel import Panel, bars, with_gaps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: What modules do before a query runs.
BEFORE: list[Callable[[], None]] = []

BARS = """b AS (
  SELECT symbol, date, min_by(px, ord) AS open, max(px) AS high, min(px) AS low, max_by(px, ord) AS close,
         CAST(sum(l_quantity) AS DOUBLE) AS volume, sum(l_extendedprice) AS amount
  FROM (SELECT l_suppkey AS symbol, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS date, l_quantity, l_extendedprice,
               l_extendedprice / l_quantity AS px,
               row_number() OVER (PARTITION BY l_suppkey, date_trunc('{unit}', l_shipdate)
                                  ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS ord
        FROM lineitem) GROUP BY 1, 2)"""
WEEKS = BARS.format(unit="week")
GAPS = "g AS (SELECT * REPLACE (CASE WHEN (symbol * 31 + date_diff('day', DATE '1970-01-05', date) // 7) % 17 <> 0 THEN close END AS close) FROM b)"
META = """meta AS (SELECT s_suppkey AS symbol, s_nationkey AS industry, greatest(s_acctbal, 0.0) + 1 AS size, n_regionkey AS sector
  FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


#: Unit prices often end in an exact half of the last digit; this breaks such ties alike in both engines.
NUDGE = 1.7e-9


def rounded(df: DataFrame, digits: int | dict[str, int]) -> DataFrame:
    """Doubles to a number of digits, without negative zeros."""
    of = lambda c: digits if isinstance(digits, int) else digits.get(c, 6)
    return df.select(*[(F.round(F.col(c) + NUDGE, of(c)) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def add(name: str, spark: Callable[[SparkSession, str], DataFrame], sql: str | None = None, digits: int | dict[str, int] = 6) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered")

    def run(s: SparkSession, d: str) -> DataFrame:
        for f in BEFORE:
            f()
        return rounded(spark(s, d), digits)

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr} + {NUDGE}, {digits}) + 0.0"


WINDOWS = "WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS {m} PRECEDING), o AS (PARTITION BY symbol ORDER BY date), a AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), d AS (PARTITION BY date)"


def add_panel(name: str, spark: Callable[[Panel], dict[str, Column]], sql: dict[str, str], panel: str = "b", n: int = 10, digits: int | dict[str, int] = 6, ctes: str = "", source: str | None = None, whole: tuple[str, ...] = ()) -> None:
    """A query over weekly bars (``b``) or those with gaps (``g``): columns by name, in Spark and in SQL.

    ``ctes`` are SQL steps before the last, ``source`` the last one's name; columns in
    ``whole`` are whole numbers.
    """

    def run(s: SparkSession, d: str) -> DataFrame:
        df = bars(s, d)
        p = Panel(with_gaps(df) if panel == "g" else df)
        cols = spark(p)
        return p.select(**{k: c.cast("long") if k in whole else c.cast("double") for k, c in cols.items()})

    of = lambda c: digits if isinstance(digits, int) else digits.get(c, 6)
    cols = ", ".join(f"{f'CAST({e} AS BIGINT)' if k in whole else r(f'CAST({e} AS DOUBLE)', of(k))} AS {k}" for k, e in sql.items())
    head = f"WITH {WEEKS}, {GAPS}{', ' + ctes if ctes else ''} "
    add(name, run, f"{head}SELECT symbol, date, {cols} FROM {source or panel} {WINDOWS.format(m=n - 1)}", digits)
