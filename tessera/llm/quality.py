"""Quality classifier: hashed word n-gram logistic regression (FTRL-Proximal).

Tokens are runs of letters, of digits, or of other non-space characters inside
words, so that ``thnd***`` is a letter run and a symbol run.  A document is the
sparse vector of its hashed token 1- and 2-grams with value count / sqrt(sum of
squares), and of hashed 1-grams of token classes.  A 2-gram of two equal tokens is
hashed as a repeat mark, whatever the token.  Training follows the regularised
leader with per-coordinate rates; scoring is a sparse dot product over whole texts.

Defined cases: null and empty texts have no features and get the score of the
bias; no usable labels give 0.5 for all; labels of one class give that class;
repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, in_hash_order, labelled, map_batches, record, table
from tessera.llm.text import U64, Texts, mix, ngrams, pieces

BITS = 18
#: The bound on the sample that is fitted on: documents of each class.
SAMPLE_PER_CLASS = 1500

_CLASS = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 1


def _tokens(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of each token, and each document's first token (n + 1)."""
    cls = _CLASS[t.buf]
    edge = np.empty(len(cls), bool)
    if len(cls):
        edge[0] = True
        np.not_equal(cls[1:], cls[:-1], out=edge[1:])
        edge[t.offs[t.offs < len(cls)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(cls))[: len(starts)]
    keep = cls[starts] != 0
    starts, ends = starts[keep], ends[keep]
    kind = cls[starts].astype(np.int64)
    # upper case, long and short symbol runs are classes of their own
    kind += 4 * ((t.buf[starts] >= 65) & (t.buf[starts] <= 90)) + 8 * np.minimum(ends - starts, 3)
    return t.hashes(starts, ends, lower=False), kind, np.searchsorted(starts, t.offs)


def features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each n-gram, its document's offsets, and token counts."""
    h, kind, offs = _tokens(t)
    n = np.diff(offs)
    two = ngrams(h, 2)
    if len(two):
        two[h[1:] == h[:-1]] = U64(0x5EED)
    inside = np.ones(len(two), bool)
    inside[offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] <= len(two))] - 1] = False
    own = np.repeat(np.arange(t.n), n)
    idx = np.concatenate([h, two[inside], mix(kind.astype(np.uint64) + U64(77))])
    doc = np.concatenate([own, own[: len(two)][inside], own])
    order = np.argsort(doc, kind="stable")
    idx = (idx[order] >> U64(64 - BITS)).astype(np.int32)
    return idx, np.searchsorted(doc[order], np.arange(t.n + 1)), n


def scores(t: Texts, w: np.ndarray, bias: float) -> np.ndarray:
    idx, offs, n = features(t)
    z = np.zeros(t.n)
    has = np.flatnonzero(np.diff(offs))
    if len(has):
        z[has] = np.add.reduceat(w[idx], offs[has], dtype=np.float64)
    return 1 / (1 + np.exp(-np.clip(bias + z / np.maximum(n, 1) * SCALE, -30, 30)))


#: Values are counts times this over the number of tokens.
SCALE = 20.0


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], alpha=0.15, beta=1.0, l1=0.02, l2=0.2, epochs=6, seed=7) -> tuple[np.ndarray, float]:
    """Weights and bias from (buckets, values, label) rows; classes weigh the same."""
    dim = 1 << BITS
    z, g2, w = np.zeros(dim + 1), np.zeros(dim + 1), np.zeros(dim + 1)
    pos = sum(y for *_, y in rows)
    if not rows:
        return w[:dim].astype(np.float32), 0.0
    if pos in (0, len(rows)):
        return w[:dim].astype(np.float32), 6.0 if pos else -6.0
    weigh = {1: len(rows) / (2 * pos), 0: len(rows) / (2 * (len(rows) - pos))}
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, x, y = rows[k]
            i, x = np.append(i, dim), np.append(x, 1.0)
            zi, gi = z[i], g2[i]
            reg = np.where(i == dim, 0.0, l1)
            wi = np.where(np.abs(zi) <= reg, 0.0, -(zi - np.sign(zi) * reg) / ((beta + np.sqrt(gi)) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(wi @ x, -30, 30))) - y) * x * weigh[y]
            sigma = (np.sqrt(gi + g * g) - np.sqrt(gi)) / alpha
            z[i] = zi + g - sigma * wi
            g2[i] = gi + g * g
    reg = np.full(dim + 1, l1)
    reg[dim] = 0
    w = np.where(np.abs(z) <= reg, 0.0, -(z - np.sign(z) * reg) / ((beta + np.sqrt(g2)) / alpha + l2))
    return w[:dim].astype(np.float32), float(w[dim])


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> tuple[np.ndarray, float]:
    """Fitted on at most ``per_class`` labelled documents of each class where ``keep``.

    Executors turn the sampled texts into distinct (bucket, count) pairs; only
    those reach the driver.
    """

    def run(b: pa.RecordBatch):
        for lo, hi, t in pieces(b):
            idx, offs, n = features(t)
            us, cs = [], []
            for k in range(t.n):
                u, c = np.unique(idx[offs[k] : offs[k + 1]], return_counts=True)
                us.append(u.astype(np.int32).tobytes())
                cs.append((c / max(n[k], 1) * SCALE).astype(np.float32).tobytes())
            part = b.slice(lo, hi - lo)
            yield record(doc_id=part.column("doc_id"), label=part.column("label"), idx=pa.array(us, pa.binary()), val=pa.array(cs, pa.binary()))

    got = map_batches(labelled(docs, labels, label, keep, per_class).select("doc_id", "text", "label"), run, "doc_id long, label int, idx binary, val binary").collect()
    order = in_hash_order(np.array([r.doc_id for r in got], np.int64), 1) if got else []
    rows = [(np.frombuffer(got[k].idx, np.int32), np.frombuffer(got[k].val, np.float32).astype(float), got[k].label) for k in order]
    return ftrl(rows)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``doc_id, score`` of every row."""
    w, bias = model

    def run(b: pa.RecordBatch):
        out = [scores(t, w, bias) for _, _, t in pieces(b)]
        return record(doc_id=b.column("doc_id"), score=np.concatenate(out) if out else np.zeros(0))

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def keep(docs: DataFrame, model: tuple[np.ndarray, float], least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text scores ``least`` or more."""
    w, bias = model

    def run(b: pa.RecordBatch):
        for lo, hi, t in pieces(b):
            yield b.slice(lo, hi - lo).filter(pa.array(scores(t, w, bias) >= least))

    return map_batches(docs, run, docs.schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, crc_mod("doc_id", 3) != 1)
    return score(docs, model).select(
        "doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
