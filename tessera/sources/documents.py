"""Text documents: identity, normalising, feeds and JSON lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPACE = r"[ \t\n\r\f\x0B]+"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def normalized(x: Column) -> Column:
    """Without NUL characters, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.replace(x, F.lit("\0"), F.lit("")), SPACE, " "))


def strip_html(x: Column) -> Column:
    """Tags as spaces, the common entities resolved, white space normalised."""
    x = F.regexp_replace(x, "<[^>]+>", " ")
    for a, b in ENTITIES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(x, SPACE, " "))


def identified(df: DataFrame) -> DataFrame:
    """Adds ``content_hash`` and ``document_id``: a hash of the source with the external id, else the URL, else the content."""
    h = F.sha2(normalized(F.col("content")), 256)
    ident = F.coalesce(F.nullif(F.trim("external_id"), F.lit("")), F.nullif(F.trim("source_url"), F.lit("")), h)
    return df.withColumn("content_hash", h).withColumn("document_id", F.sha2(F.concat_ws("|", "source", ident), 256))


def dedup_documents(df: DataFrame, order: list[Column]) -> DataFrame:
    """The first document of each (source, content)."""
    w = Window.partitionBy("source", "content_hash").orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dedup_stream(df: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """The streaming form: the first of each (source, content) within a watermark."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(["source", "content_hash"])


def exclude_prefixes(df: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    bad = F.lit(False)
    for p in prefixes:
        bad = bad | F.col(column).startswith(p)
    return df.where(~F.coalesce(bad, F.lit(False)))


def first_filled(*cols: str) -> Column:
    """The first of the columns that isn't null or blank."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in cols])


def read_json_list(spark: SparkSession, path: str, fields: dict[str, str], source: str) -> DataFrame:
    """Documents from files that hold one JSON list each; ``fields`` maps our names to theirs."""
    raw = spark.read.option("multiLine", True).json(path)
    return raw.select(F.lit(source).alias("source"), *[(F.col(theirs) if theirs in raw.columns else F.lit(None)).cast("string").alias(ours) for ours, theirs in fields.items()])


FEED = "source string, title string, content string, source_url string, external_id string, published_at timestamp"


def parse_feed(text: str, source: str) -> list[tuple]:
    """Items of an RSS or Atom document; an answer that is no feed raises."""
    import xml.etree.ElementTree as ET
    from email.utils import parsedate_to_datetime

    head = text.lstrip()[:500].lower()
    if "<html" in head or "<!doctype html" in head:
        raise ValueError("the source sent a web page, not a feed")
    out = []
    for node in ET.fromstring(text).iter():
        if node.tag.rpartition("}")[2] not in ("item", "entry"):
            continue
        got = {c.tag.rpartition("}")[2]: (c.text or c.get("href") or "").strip() for c in node}
        when = got.get("pubDate") or got.get("published") or got.get("updated")
        at = None
        if when:
            try:
                at = pd.Timestamp(parsedate_to_datetime(when)) if "," in when else pd.Timestamp(when)
            except (TypeError, ValueError):
                at = None
        if at is not None:
            at = (at.tz_convert("UTC") if at.tzinfo else at).tz_localize(None).to_pydatetime()
        body = got.get("content") or got.get("encoded") or got.get("description") or got.get("summary") or ""
        out.append((source, got.get("title"), body, got.get("link"), got.get("guid") or got.get("id"), at))
    return out


def read_feeds(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Documents from feed files; parsed by executors, one file a row."""
    def run(batches):
        for pdf in batches:
            rows = [r for t in pdf["value"] for r in parse_feed(t, source)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in FEED.split(", ")])

    return spark.read.text(path, wholetext=True).mapInPandas(run, FEED)
