"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Each source has a target in words.  Whole epochs of a source come first; the rest
of its target is filled with documents in the order of exponential keys
``-ln(u) / quality`` (u from a digest of id, source and, without an id, text), whose
sizes are prefix-summed up to the budget; the document that crosses it stays if that
comes nearer.  The n keys of a source are cut into about sqrt(n) ranges, by their
distribution under its histogram of quality: a source with a third of all rows is
summed range by range, and only the range in which its budget ends is ordered row by
row, so that no task orders or sums more than about sqrt(n) rows.

Defined cases: null and empty texts have size 0; a null source is a source of its
own and sorts last; a source without words has target 0; repeated rows are
separate rows (equal keys go by size, then id); an empty table gives no rows;
reruns agree, as nothing depends on the order of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import map_batches, record, saved, table
from tessera.llm.rules import per_doc
from tessera.llm.text import SPACE, pieces

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL, MOST = 1.5, 2.0
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def targets(sizes: list[int], weights: list[float], total: float = TOTAL, most: float = MOST) -> list[float]:
    """Shares of ``total`` x all sizes by weight; none above ``most`` x its size, the excess reshared.

    Sources fill up in the order of most x size / weight: with the first k full, the rest
    share what is left by weight; k is the least for which none of them is above.
    """
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    left, share = sum(weights), 0.0
    goal, full = total * sum(sizes), 0.0
    for i in order:
        share = (goal - full) / left
        if share * weights[i] <= most * sizes[i]:
            break
        full, left = full + most * sizes[i], left - weights[i]
        share = float("inf")
    return [min(most * s, share * w) if s else 0.0 for s, w in zip(sizes, weights, strict=True)]


def sized(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, source, size, quality`` and the ``carry`` columns (long); quality is 1/2 plus the share of letters among word bytes."""
    def run(b: pa.RecordBatch):
        for lo, hi, t in pieces(b):
            n = np.diff(t.words()[2])
            letters, chars = per_doc(_LETTER[t.buf], t.offs), per_doc(~SPACE[t.buf], t.offs)
            part = b.slice(lo, hi - lo)
            yield record(doc_id=part.column("doc_id"), source=part.column("source"), size=n.astype(np.int64), quality=0.5 + letters / np.maximum(chars, 1), **{c: part.column(c) for c in carry})

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text", *carry), run, ", ".join(["doc_id long, source string, size long, quality double", *(f"{c} long" for c in carry)]))


def mix_sources(rows: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST, seed: int = 11, tie: str | None = None) -> DataFrame:
    """``rows`` (doc_id, source, size, quality) with ``source_size, target, taken, times``.

    ``tie`` is a column (long) that stands for null ids and orders rows that are equal otherwise.
    The totals of each source and its histogram of quality (some 20 small rows a source) come to the driver.
    """
    spark = rows.sparkSession
    ident = F.coalesce(F.col("doc_id").cast("string"), F.col(tie).cast("string") if tie else F.lit(""), F.lit(""))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), ident, F.coalesce("source", F.lit(""))))
    # 52 bits of the digest, between 0 and 1 and never either
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = rows.withColumn("key", -F.log(u) / F.col("quality"))
    # a histogram of quality by source: bins of 1/20
    hist = rows.groupBy("source", F.floor(F.col("quality") * 20).alias("b")).agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.avg("quality").alias("q")).collect()
    per = []
    for source in {r.source for r in hist}:
        mine = sorted((r for r in hist if r.source == source), key=lambda r: r.b)
        n = sum(r.n for r in mine)
        per.append(Row(source=source, source_size=sum(r.s for r in mine), n=n, share=[r.n / n for r in mine], q=[r.q for r in mine]))
    per.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    goals = targets([r.source_size for r in per], [weights[i % len(weights)] for i in range(len(per))], total, most)
    plan = []
    for r, t in zip(per, goals, strict=True):
        epochs = int(t // r.source_size) if r.source_size else 0
        plan.append((r.source, r.source_size, t, epochs, max(0.0, t - epochs * r.source_size), math.isqrt(r.n - 1) + 1, r.share, r.q))
    plan = F.broadcast(spark.createDataFrame(plan, "p_source string, source_size long, target double, epochs int, rest double, ranges long, shares array<double>, qualities array<double>"))
    # the share of a source's keys below a key, from its histogram: even over [0, 1), so ranges hold about as many rows each
    below = F.aggregate(F.zip_with("shares", "qualities", lambda p, q: p * (1 - F.exp(-q * F.col("key")))), F.lit(0.0), lambda a, x: a + x)
    at = F.greatest(F.lit(0), F.least(F.floor(below * F.col("ranges")), F.col("ranges") - 1))
    rows = rows.join(plan, rows.source.eqNullSafe(F.col("p_source"))).drop("p_source").withColumn("range", at)
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("s"), F.first("rest").alias("r"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before)
    whole = F.col("before") + F.col("s") <= F.col("r")
    state = sums.select(
        F.col("source").alias("b_source"), F.col("range").alias("b_range"), "before",
        F.when(whole, 2).when(F.col("before") < F.col("r"), 1).otherwise(0).alias("state"),
    )
    rows = rows.join(state, rows.source.eqNullSafe(F.col("b_source")) & (rows.range == F.col("b_range"))).drop("b_source", "b_range")
    w = Window.partitionBy("source", "range").orderBy("key", "size", "doc_id", *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.where("state = 1").withColumn("upto", F.col("before") + F.sum("size").over(w))
    # the document that crosses the budget stays if that comes nearer to it
    fits = (F.col("upto") <= F.col("rest")) | (F.col("upto") - F.col("rest") < F.col("rest") - (F.col("upto") - F.col("size")))
    edge = edge.withColumn("chosen", fits.cast("int")).drop("upto")
    rest = rows.where("state <> 1").withColumn("chosen", (F.col("state") == 2).cast("int"))
    times = (F.col("epochs") + F.when(F.col("rest") > 0, F.col("chosen")).otherwise(0)).cast("int")
    out = rest.unionByName(edge).withColumn("times", times).withColumn("taken", F.col("times") * F.col("size"))
    return out.drop("key", "ranges", "shares", "qualities", "range", "before", "state", "chosen", "epochs", "rest")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("tie", F.xxhash64("text"))
    return mix_sources(saved(sized(docs, ("tie",))), tie="tie").select("doc_id", "size", "source_size", "target", "taken", "times", "source")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
    octet_length(encode(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g'))) AS chars,
    octet_length(encode(regexp_replace(coalesce(text, ''), '[\x00-@\[-`{-\x7F]', '', 'g'))) AS letters FROM documents),
k AS (
  SELECT *, -ln((CAST(CAST('0x' || substr(md5('11|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
    / (0.5 + letters / greatest(chars, 1)) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (ARRAY[3.0, 1.0, 2.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY 1),
f AS (SELECT *, CAST(source_size AS DOUBLE) AS ss, row_number() OVER (ORDER BY 2 * CAST(source_size AS DOUBLE) / CAST(w AS DOUBLE), source NULLS LAST) AS o FROM s),
l AS (
  SELECT *, (1.5 * sum(ss) OVER () - 2 * coalesce(sum(ss) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / CAST(sum(w) OVER (ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS share FROM f),
c AS (SELECT min_by(share, o) AS share FROM l WHERE share * CAST(w AS DOUBLE) <= 2 * ss),
t AS (SELECT source, source_size, CASE WHEN source_size > 0 THEN least(2 * ss, coalesce((SELECT share FROM c), 'infinity'::DOUBLE) * CAST(w AS DOUBLE)) ELSE 0.0 END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
x AS (
  SELECT k.*, source_size, target, epochs, greatest(0.0, target - epochs * source_size) AS rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, size, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM k JOIN e ON e.source IS NOT DISTINCT FROM k.source),
y AS (SELECT *, CAST(epochs + CASE WHEN rest > 0 AND (upto <= rest OR upto - rest < rest - (upto - size)) THEN 1 ELSE 0 END AS INTEGER) AS times FROM x)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(times * size AS BIGINT) AS taken, times, source FROM y
"""
