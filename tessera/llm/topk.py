"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors are quantised to integers and stored in blocks of neighbouring rows, each
with its forward index (the dense rows) and the maximum and minimum of every
component.  For a query the bound of a block is the sum over components of the
largest possible term; blocks are visited in the order of falling bounds and
scored until the bound falls below the k-th score.  Queries and blocks meet in a
grid of bounded cells, and each query's best of every cell are merged.

Defined cases: vectors that are null or hold null or non-finite components, or
have no id, take no part; vectors of different lengths aren't compared; repeated
rows are separate candidates, and a row never finds itself; ties go to the
smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import map_batches, record, saved, table

BLOCK, CELL_BLOCKS, CELL_QUERIES = 256, 32, 2048
SCHEMA = "part string, dim int, block long, n int, ids binary, uids binary, vecs binary, top binary, low binary"


def blocks(vectors: DataFrame, every: int, scale: float = 256.0) -> DataFrame:
    """Quantised blocks of all rows (part 'd') and of the query rows (part 'q')."""
    df = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))")

    def run(batches):
        made, base = 0, TaskContext.get().partitionId() << 33
        for b in batches:
            ids = b.column("vec_id").to_numpy(zero_copy_only=False)
            lists = b.column("v")
            size = np.diff(lists.offsets.to_numpy())
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
            start = np.cumsum(size) - size
            for dim in np.unique(size[size > 0]) if len(size) else []:
                rows = np.flatnonzero(size == dim)
                x = np.floor(flat[start[rows][:, None] + np.arange(dim)] * scale)
                uid = base + made + np.arange(len(rows))
                made += len(rows)
                own = ids[rows]
                for part, pick in (("d", np.arange(len(rows))), ("q", np.flatnonzero(own % every == 0))):
                    for lo in range(0, len(pick), BLOCK):
                        k = pick[lo : lo + BLOCK]
                        v = x[k]
                        yield record(
                            part=[part], dim=pa.array([dim], pa.int32()), block=[int(uid[k[0]])], n=pa.array([len(k)], pa.int32()),
                            ids=[own[k].astype(np.int64).tobytes()], uids=[uid[k].tobytes()], vecs=[v.tobytes()],
                            top=[v.max(0).tobytes()], low=[v.min(0).tobytes()],
                        )

    return df.mapInArrow(run, SCHEMA)


def best_of(q: np.ndarray, quids: np.ndarray, data: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int):
    """Ids, uids and scores (queries x k) over the blocks; missing places have score -inf."""
    top, low = np.array([d[3] for d in data]), np.array([d[4] for d in data])
    bound = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    score = np.full((len(q), k), -np.inf)
    ids, uids = np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), -1)
    live = np.arange(len(q))
    for r in range(len(data)):
        live = live[bound[live, order[live, r]] >= score[live, -1]]
        if not len(live):
            break
        at = order[live, r]
        for blk in np.unique(at):
            rows = live[at == blk]
            vid, vuid, vecs = data[blk][:3]
            s = q[rows] @ vecs.T
            s[quids[rows][:, None] == vuid[None, :]] = -np.inf
            s = np.concatenate([score[rows], s], 1)
            i = np.concatenate([ids[rows], np.broadcast_to(vid, (len(rows), len(vid)))], 1)
            u = np.concatenate([uids[rows], np.broadcast_to(vuid, (len(rows), len(vid)))], 1)
            o = np.lexsort((u, i, -s), axis=1)[:, :k]
            score[rows], ids[rows], uids[rows] = (np.take_along_axis(a, o, 1) for a in (s, i, u))
    return ids, uids, score


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """``query_id, rank, vec_id, score`` for rows whose id is divisible by ``every``."""
    stored = saved(blocks(vectors, every))
    counts = {r.part: r for r in stored.groupBy("part").agg(F.count("*").alias("b"), F.sum("n").alias("n")).collect()}
    g = max(1, -(-counts["d"].b // CELL_BLOCKS)) if "d" in counts else 1
    h = max(1, -(-counts["q"].n // CELL_QUERIES)) if "q" in counts else 1
    near = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = stored.where("part = 'd'").withColumn("g", near(g)).withColumn("h", all_of(h))
    query = stored.where("part = 'q'").select("dim", "n", "ids", "uids", "vecs", near(h).alias("h")).withColumn("g", all_of(g))

    def cell(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if q.empty or d.empty:
            return pd.DataFrame({"query": [], "query_id": [], "uid": [], "vec_id": [], "score": []}).astype("int64")
        dim = int(q["dim"].iloc[0])
        arr = lambda s, t: np.frombuffer(s, t)
        data = [(arr(r.ids, np.int64), arr(r.uids, np.int64), arr(r.vecs, float).reshape(-1, dim), arr(r.top, float), arr(r.low, float)) for r in d.itertuples()]
        qv = np.concatenate([arr(x, float).reshape(-1, dim) for x in q["vecs"]])
        qid, quid = (np.concatenate([arr(x, np.int64) for x in q[c]]) for c in ("ids", "uids"))
        ids, uids, score = best_of(qv, quid, data, k)
        ok = np.isfinite(score)
        row = np.nonzero(ok)[0]
        return pd.DataFrame({"query": quid[row], "query_id": qid[row], "uid": uids[ok], "vec_id": ids[ok], "score": score[ok].astype(np.int64)})

    found = query.groupBy("dim", "g", "h").cogroup(data.groupBy("dim", "g", "h")).applyInPandas(cell, "query long, query_id long, uid long, vec_id long, score long")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(d.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""
