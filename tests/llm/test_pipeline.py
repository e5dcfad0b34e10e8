import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import minhash, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_dedup", "mixing", "bpe"]
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1], SF).cache()
        if k < 4:
            assert out.columns == docs.columns
        kept.append(out)
    n = [d.count() for d in kept]
    assert n[0] > n[1] > n[2] >= n[3] and n[5] == n[4]
    rejected = docs.join(kept[1], "doc_id", "left_anti").join(labels, "doc_id")
    assert rejected.where("quality = 1").count() <= 0.05 * rejected.count()
    # of each group of near-duplicates one stays, the smallest id
    want = minhash.near_duplicates(kept[2], n=5).where("kept").select("doc_id").distinct()
    assert {r[0] for r in want.collect()} == {r.doc_id for r in kept[3].collect()}
    times = kept[4].groupBy("doc_id").count()
    assert times.agg(F.max("count")).first()[0] <= 2


def test_null_and_repeated_ids(spark):
    """Rows without an id, and different texts of one id, go through dedup and mixing; repeated rows don't."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(None, text(0)), (None, text(1)), (None, None), (5, text(2)), (5, text(3)), (5, text(4)), (5, text(4)), (5, text(4) + " more"), (6, text(2)), (7, text(5)), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    out = corpus_pipeline.dedup_stage(spark, docs, SF)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    last = [x for x in got if x[0] == 5 and x[1].startswith(text(4))]
    assert len(last) == 1 and out.columns == docs.columns
    assert got == sorted([(None, text(0)), (None, text(1)), (None, None), (5, text(2)), (5, text(3)), *last, (7, text(5)), (8, "")], key=str)
    again = corpus_pipeline.dedup_stage(spark, docs.repartition(3, "text"), SF)
    assert sorted(((r.doc_id, r.text) for r in again.collect()), key=str) == got
    mixed = [(r.doc_id, r.text) for r in corpus_pipeline.mixing_stage(spark, out, SF).collect()]
    # the target is 1.5 epochs of the source
    assert set(mixed) == set(got) and all(mixed.count(x) <= 2 for x in got)
    size = lambda part: sum(len((t or "").split()) for _, t in part)
    assert abs(size(mixed) - 1.5 * size(got)) <= 21


def test_registry():
    assert [f"op{n}_" for n in range(1, 11)] == sorted({k.split("_")[0] + "_" for k in registry.QUERIES}, key=lambda s: int(s[2:-1]))
    assert set(registry.SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = registry.QUERIES[name](spark, SF)
    rel = c.execute(registry.SQL[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, rel.fetchall()))
