"""Panels: long tables keyed by (symbol, date).

A ``Panel`` holds a DataFrame and gives windows over it.  Nested window expressions
aren't legal in one projection, so operators ``let`` an operand become a column
first; all of them share one exchange and sort by (symbol, date), or one by date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


class Panel:
    def __init__(self, df: DataFrame, symbol: str = "symbol", date: str = "date"):
        self.df, self.symbol, self.date, self._n = df, symbol, date, 0

    def let(self, x: Column | str | float, name: str | None = None) -> Column:
        """``x`` as a column of the panel; a string names one that is there already."""
        if isinstance(x, str):
            return F.col(x)
        if name is None:
            self._n += 1
            name = f"_{self._n}"
        self.df = self.df.withColumn(name, x if isinstance(x, Column) else F.lit(x))
        return F.col(name)

    def order(self) -> WindowSpec:
        return Window.partitionBy(self.symbol).orderBy(self.date)

    def last(self, n: int) -> WindowSpec:
        return self.order().rowsBetween(-(n - 1), 0)

    def sofar(self) -> WindowSpec:
        return self.order().rowsBetween(Window.unboundedPreceding, 0)

    def day(self, *more: str | Column) -> WindowSpec:
        return Window.partitionBy(self.date, *more)

    def require_unique(self) -> None:
        """Raises unless (symbol, date) is a key."""
        if not self.df.groupBy(self.symbol, self.date).count().where("count > 1").isEmpty():
            raise ValueError(f"({self.symbol}, {self.date}) repeats")

    def select(self, **cols: Column) -> DataFrame:
        return self.df.select(self.symbol, self.date, *[c.alias(k) for k, c in cols.items()])


def window_size(n: int) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError(f"a window is a positive number of rows, not {n!r}")
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """Price bars per supplier and week or month, in one partially aggregated shuffle."""
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.date_trunc(unit, "l_shipdate").cast("date").alias("date"),
        "l_quantity", "l_extendedprice", (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), at.alias("at"),
    )
    return li.groupBy("symbol", "date").agg(
        F.min_by("px", "at").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "at").alias("close"),
        F.sum("l_quantity").cast("double").alias("volume"), F.sum("l_extendedprice").alias("amount"),
    )


def with_gaps(df: DataFrame) -> DataFrame:
    """Bars with some closes missing, for the semantics of gaps."""
    week = F.floor(F.datediff("date", F.lit("1970-01-05").cast("date")) / 7)
    return df.withColumn("close", F.when((F.col("symbol") * 31 + week) % 17 != 0, F.col("close")))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industry (nation) and size of each supplier."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("sector"))
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").alias("industry"), (F.greatest("s_acctbal", F.lit(0.0)) + 1).alias("size")
    )
    return s.join(F.broadcast(n), F.col("industry") == F.col("k")).drop("k")


def calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """The distinct dates, numbered from 0: one row a date, however many symbols."""
    return df.select(date).distinct().withColumn("t", F.row_number().over(Window.orderBy(date)) - 1)
