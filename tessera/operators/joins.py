"""Point-in-time joins: as-of, validity intervals, report lags, upserts.

An as-of join is a union and one window: right rows sort before left rows of the same
time, the last right row so far is the match.  One shuffle on the key, linear in the
rows, no inequality join.  A key with very many rows is one window partition; salt
keys by time ranges before the join if a single key holds a large share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.panel import Panel


def as_of(left: DataFrame, right: DataFrame, key: str, left_on: str, right_on: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time.

    Of right rows at the same time the greatest by ``ties`` counts; the right
    columns (but the key) are null without a match.
    """
    cols = [c for c in right.columns if c != key]
    lefts = left.select(F.col(key).alias("_k"), F.col(left_on).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    rights = right.select(F.col(key).alias("_k"), F.col(right_on).alias("_t"), F.lit(0).alias("_side"), F.struct(*cols).alias("_r"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    order = [F.col("_t"), F.col("_side"), *[F.col(f"_r.{c}") for c in ties]]
    w = Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return out.select("_l.*", *[F.col(f"_m.{c}").alias(c) for c in cols])


def as_of_valid(left: DataFrame, right: DataFrame, key: str, left_on: str, start: str, end: str, closed: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """As-of with validity: the match holds while time < end (<= end if closed) or end is null."""
    out = as_of(left, right, key, left_on, start, ties)
    at = F.col(left_on) <= F.col(end) if closed else F.col(left_on) < F.col(end)
    ok = F.col(start).isNotNull() & (F.col(end).isNull() | at)
    return out.select(*left.columns, *[F.when(ok, F.col(c)).alias(c) for c in right.columns if c != key])


def overlaps(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Intervals that begin before the one before them has ended."""
    w = Window.partitionBy(key).orderBy(start, end)
    return intervals.withColumn("previous_end", F.lag(end).over(w)).where(F.col("previous_end") > F.col(start))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """All rows of both, of each key the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return old.unionByName(new).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def pit_events(events: DataFrame, key: str, announced: str, period: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Announcements in the order they became known.

    Void ones (announced before their period, or without dates) go; of a day the latest
    period stays; a revision of a period older than one already known goes; ``report_seq``
    numbers the distinct periods from 0.
    """
    ok = F.col(announced).isNotNull() & F.col(period).isNotNull() & (F.col(announced) >= F.col(period))
    day = first_of(events.where(ok), [key, announced], [F.desc(period), *[F.desc(c) for c in ties]])
    w = Window.partitionBy(key).orderBy(announced)
    known = day.withColumn("_top", F.max(period).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col(period) == F.col("_top")).drop("_top")
    return known.withColumn("report_seq", F.dense_rank().over(Window.partitionBy(key).orderBy(period)) - 1)


def report_lag(p: Panel, x: Column, k: int = 1, period: str = "report_period") -> Column:
    """Value of the k-th report period before the current one, as it was last known.

    Periods don't fall over time (see ``pit_events``), so a period's value is final
    once the next is disclosed; a disclosed period without a value counts.
    """
    x = p.let(x)
    new = p.let((F.col(period).isNotNull() & ~F.col(period).eqNullSafe(F.lag(period).over(p.order()))).cast("int"))
    seq = p.let(F.sum(new).over(p.sofar()))
    # rows of a period share a frame, so each period is read once, in the panel's own partitions
    frame = Window.partitionBy(p.symbol).orderBy(seq).rangeBetween(-k, -k)
    return p.let(F.max_by(x, F.when(x.isNotNull(), F.col(p.date))).over(frame))


def report_delta(p: Panel, x: Column, k: int = 1, period: str = "report_period") -> Column:
    x = p.let(x)
    return p.let(x - report_lag(p, x, k, period))


def forward_fill(p: Panel, *cols: str) -> Panel:
    """The latest value so far of each column, per symbol."""
    w = p.sofar()
    p.df = p.df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    return p
