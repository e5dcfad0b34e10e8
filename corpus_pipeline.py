"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep
the columns of documents.  Models learn from the labels beside the input and score
every text that the stage before kept.  Where a stage has to find rows again it numbers
them itself, so null and repeated ids lose no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, minhash, mixing, quality, toxicity
from tessera.llm.common import crc_mod, saved, table

#: No SQL can express the learned stages.
ORACLE_SQL = None


#: A stage's number of a row, and a hash of all its columns.
ROW, HASH = "tessera_row", "tessera_hash"


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ROW and HASH, written once so that numbers don't change."""
    return saved(docs.withColumns({HASH: F.xxhash64(*docs.columns), ROW: F.monotonically_increasing_id()}))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the texts that the quality classifier rejects (score under 0.5)."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return quality.keep(docs, model)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the texts that the toxicity network marks (score of 0.5 or more)."""
    net = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return toxicity.keep(docs, net)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest id; five words, 0.8 or more.

    Rows without an id all stay, as in op1.  Of rows that share the smallest id of a group
    one stays, that with the least hash of its columns; rows that share an id and are in
    different groups are different documents and stay each.  Texts without words are in no
    group: of those that share an id one stays.
    """
    rows = _numbered(docs)
    found = saved(minhash.near_duplicates(rows, n=5, share=80, carry=(ROW, HASH)).where("kept").select("doc_id", "component", ROW, HASH))
    one = found.where("doc_id IS NOT NULL").groupBy("component", "doc_id").agg(F.min(F.struct(HASH, ROW)).alias("r")).select(f"r.{ROW}")
    stay = one.unionByName(found.where("doc_id IS NULL").select(ROW))
    return rows.join(stay, ROW, "left_semi").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it (0, 1 or 2)."""
    rows = _numbered(docs)
    mix = mixing.mix_sources(saved(mixing.sized(rows, (ROW, HASH))), tie=HASH).select(ROW, "times").where("times > 0")
    return rows.join(mix, ROW).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as counts and digests."""
    return bpe.digests(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
