"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Words are runs of letters, lower-cased.  A word's input is the sum of hashed
embeddings of the word itself and of character n-grams at its start and end.
Windows of ``LENGTH`` words that overlap by half run through a forward and a
backward gated recurrent unit; attention pools the states; a text's score is that
of its most toxic window.  Training is numpy back-propagation through time on
labelled texts, each represented by that of all its windows that scores highest at
the time (one at random before the first round), with words left out at random.  A
quarter of the sample (none of a small one) is held back: a logistic fit of its labels on the maxima of its
whole texts, as scored, gives the score's scale and the cut between the classes.

Defined cases: null and empty texts (and texts without letters) get the score of an
empty window; no usable labels give 0.5 for all, labels of one class that class;
repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, in_hash_order, labelled, map_batches, record, saved, table
from tessera.llm.text import U64, Texts, mix, pieces

LENGTH, STRIDE = 32, 16
BITS, DIM, HIDDEN = 16, 12, 8
#: Character inputs: bytes from a word's start, and from its end.
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7), (4,)
INPUTS = 1 + len(PREFIXES) + len(SUFFIXES)
#: Bounds on the sample that is fitted on: whole texts of each class, and their words in all.
SAMPLE_PER_CLASS, SAMPLE_WORDS = 1200, 1 << 20
#: Texts that a class needs for a quarter of it to be held back.
HELD = 128

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def inputs(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashed inputs (words x INPUTS) and each document's first word (n + 1)."""
    s, e = t.runs(_LETTER[t.buf])
    spans = [(s, e)] + [(s, np.minimum(s + k, e)) for k in PREFIXES] + [(np.maximum(s, e - k), e) for k in SUFFIXES]
    out = np.empty((len(s), INPUTS), np.uint16)
    for k, (a, b) in enumerate(spans):
        out[:, k] = mix(t.hashes(a, b) + U64(k + 1)) >> U64(64 - BITS)
    return out, np.searchsorted(s, t.offs)


def windows(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window, and each document's first window (n + 1).

    The last window ends with the text; a text of up to LENGTH words is one window.
    """
    size = np.diff(offs)
    count = np.maximum(1, -(-(size - LENGTH) // STRIDE) + 1)
    woffs = np.concatenate([[0], np.cumsum(count)])
    k = np.arange(woffs[-1]) - np.repeat(woffs[:-1], count)
    last = np.repeat(np.maximum(size - LENGTH, 0), count)
    return np.repeat(offs[:-1], count) + np.minimum(k * STRIDE, last), woffs


def window_index(first: np.ndarray, stop: np.ndarray, pad: int) -> np.ndarray:
    """Word of each place (LENGTH x windows); ``pad`` beyond the text."""
    idx = first[None, :] + np.arange(LENGTH)[:, None]
    return np.where(idx < stop[None, :], idx, pad)


class Net:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        g = lambda *s, k=1.0: (r.standard_normal(s) * k).astype(np.float32)
        self.p = {
            "emb": g(1 << BITS, DIM, k=0.02), "wx": g(DIM, 6 * HIDDEN, k=DIM**-0.5), "bx": np.zeros(6 * HIDDEN, np.float32),
            "u": g(2, HIDDEN, 3 * HIDDEN, k=HIDDEN**-0.5), "v": g(2 * HIDDEN, k=0.3), "w": g(2 * HIDDEN, k=0.3), "b": np.zeros(1, np.float32),
        }

    def project(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs (2 directions, words + 1, 3 HIDDEN) as float32; the last word is the pad, which keeps the state."""
        p = self.p
        e = p["emb"][x[:, 0]]
        for k in range(1, x.shape[1]):
            e += p["emb"][x[:, k]]
        return self.padded(e @ p["wx"] + p["bx"])

    @staticmethod
    def padded(g: np.ndarray) -> np.ndarray:
        out = np.zeros((2, len(g) + 1, 3 * HIDDEN), np.float32)
        out[0, :-1], out[1, :-1] = g[:, : 3 * HIDDEN], g[:, 3 * HIDDEN :]
        out[:, -1, HIDDEN : 2 * HIDDEN] = 60
        return out

    def states(self, gates: np.ndarray, idx: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (LENGTH, 2, windows, HIDDEN); gates are r, z, n of each direction."""
        n, h3 = idx.shape[1], 3 * HIDDEN
        out = np.empty((LENGTH, 2, n, HIDDEN), np.float32)
        h = np.zeros((2, n, HIDDEN), np.float32)
        g = np.empty((2, n, h3), np.float32)
        for t in range(LENGTH):
            np.take(gates[0], idx[t], axis=0, out=g[0])
            np.take(gates[1], idx[LENGTH - 1 - t], axis=0, out=g[1])
            a = h @ self.p["u"]
            rz = g[..., : 2 * HIDDEN] + a[..., : 2 * HIDDEN]
            np.negative(rz, out=rz)
            np.exp(rz, out=rz)
            rz += 1
            np.reciprocal(rz, out=rz)
            r, z = rz[..., :HIDDEN], rz[..., HIDDEN:]
            m = np.tanh(g[..., 2 * HIDDEN :] + r * a[..., 2 * HIDDEN :])
            new = m + z * (h - m)
            if keep is not None:
                keep.append((h, a, r, z, m))
            out[t, 0], out[LENGTH - 1 - t, 1] = new[0], new[1]
            h = new
        return out

    def head(self, s: np.ndarray, pad: np.ndarray):
        """Attention weights (LENGTH, windows), pooled states and logits."""
        v = self.p["v"].reshape(2, HIDDEN)
        e = s[:, 0] @ v[0] + s[:, 1] @ v[1]
        e = np.where(pad, -1e9, e)
        e -= e.max(0)
        a = np.exp(e)
        a /= a.sum(0)
        pooled = np.einsum("lb,ldbh->bdh", a, s, optimize=True).reshape(s.shape[2], 2 * HIDDEN)
        return a, pooled, pooled @ self.p["w"] + self.p["b"][0]

    def logits(self, x: np.ndarray, first: np.ndarray, stop: np.ndarray, batch: int = 2048) -> np.ndarray:
        """Logits of windows over the words ``x``; only the words of a batch of windows are held as gates."""
        out = np.empty(len(first), np.float32)
        for lo in range(0, len(first), batch):
            f, z = first[lo : lo + batch], stop[lo : lo + batch]
            start, end = int(f.min()), int(np.minimum(f + LENGTH, z).max())
            gates = self.project(x[start:end])
            pad = max(end - start, 0)
            idx = window_index(f - start, z - start, pad)
            hole = idx == pad
            hole[0] = False
            out[lo : lo + batch] = self.head(self.states(gates, idx), hole)[2]
        return out

    def step(self, x: np.ndarray, hole: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients on windows x (LENGTH, windows, INPUTS)."""
        p, n = self.p, x.shape[1]
        e = p["emb"][x].sum(2)
        e[hole] = 0
        gates = self.padded((e @ p["wx"] + p["bx"]).reshape(-1, 6 * HIDDEN))
        idx = np.where(hole, LENGTH * n, np.arange(LENGTH * n).reshape(LENGTH, n))
        keep: list = []
        s = self.states(gates, idx, keep)
        lone = hole.copy()
        lone[0] = False
        a, pooled, logit = self.head(s, lone)
        d = ((1 / (1 + np.exp(-logit)) - y) * weight / len(y)).astype(np.float32)
        grad = {"w": pooled.T @ d, "b": np.array([d.sum()], np.float32)}
        dp = (d[:, None] * p["w"]).reshape(n, 2, HIDDEN)
        da = np.einsum("ldbh,bdh->lb", s, dp)
        de = a * (da - (a * da).sum(0))
        v = p["v"].reshape(2, HIDDEN)
        grad["v"] = np.einsum("lb,ldbh->dh", de, s).ravel()
        ds = a[:, None, :, None] * dp.transpose(1, 0, 2)[None] + de[:, None, :, None] * v[None, :, None, :]
        dg = np.zeros((LENGTH * n + 1, 6 * HIDDEN), np.float32)
        du, dh = np.zeros_like(p["u"]), np.zeros((2, n, HIDDEN), np.float32)
        for t in range(LENGTH - 1, -1, -1):
            h, act, r, z, m = keep[t]
            dh = dh + np.stack([ds[t, 0], ds[LENGTH - 1 - t, 1]])
            dm, dz = dh * (1 - z) * (1 - m * m), dh * (h - m) * z * (1 - z)
            dr = dm * act[..., 2 * HIDDEN :] * r * (1 - r)
            dact = np.concatenate([dr, dz, dm * r], 2)
            dpre = np.concatenate([dr, dz, dm], 2)
            dg[idx[t], : 3 * HIDDEN] = dpre[0]
            dg[idx[LENGTH - 1 - t], 3 * HIDDEN :] = dpre[1]
            du += h.transpose(0, 2, 1) @ dact
            dh = dh * z + dact @ p["u"].transpose(0, 2, 1)
        dg = dg[:-1].reshape(LENGTH, n, -1)
        dg[hole] = 0
        grad["u"] = du
        grad["wx"], grad["bx"] = np.einsum("lbd,lbg->dg", e, dg, optimize=True), dg.sum((0, 1))
        dx = dg @ p["wx"].T
        rows, inv = np.unique(x[~hole].ravel(), return_inverse=True)
        ge = np.zeros((len(rows), DIM), np.float32)
        np.add.at(ge, inv.ravel(), np.repeat(dx[~hole], x.shape[2], axis=0))
        grad["emb"] = (rows, ge)
        return grad


def _logits(net: Net, texts: list[np.ndarray], words: int = 1 << 16) -> list[np.ndarray]:
    """Logits of every window of each text, some texts at a time."""
    out, k = [], 0
    while k < len(texts):
        z, n = k, 0
        while z < len(texts) and (n == 0 or n + len(texts[z]) <= words):
            n += len(texts[z])
            z += 1
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts[k:z]])])
        first, woffs = windows(offs)
        logit = net.logits(np.concatenate(texts[k:z]), first, np.repeat(offs[1:], np.diff(woffs)))
        out += np.split(logit, woffs[1:-1])
        k = z
    return out


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of logits by a logistic fit in which the classes weigh the same."""
    a, b = 1.0, 0.0
    pos, neg = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.where(y == 1, 0.5 / pos, 0.5 / neg)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = w * (p - goal), w * p * (1 - p) + 1e-9
        grad = np.array([(g * z).sum() + 1e-3 * (a - 1), g.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 0.05), float(b)


def train(texts: list[tuple[np.ndarray, int]], epochs: int = 9, batch: int = 128, rate: float = 0.01, drop: float = 0.2, seed: int = 3, steps: int = 150) -> Net:
    """A net from (hashed inputs, label) of texts; hashed inputs are those of whole texts.

    Every fourth text of each class is held back for the cut, where both classes have
    ``HELD`` or more; below that a quarter is too few to place a cut, and it is set on the
    texts learned from.  Small samples have more epochs, so that there are ``steps`` steps.
    """
    net = Net()
    y = np.array([t[1] for t in texts], int)
    if len(set(y.tolist())) < 2:
        net.p["w"][:] = 0
        net.p["b"][:] = 0 if not len(y) else 6 if y[0] else -6
        return net
    held = texts
    if min((y == 0).sum(), (y == 1).sum()) >= HELD:
        back = np.zeros(len(y), bool)
        for cls in (0, 1):
            back[np.flatnonzero(y == cls)[3::4]] = True
        held = [t for t, h in zip(texts, back, strict=True) if h]
        texts = [t for t, h in zip(texts, back, strict=True) if not h]
        y = y[~back]
    x = np.concatenate([t[0] for t in texts])
    offs = np.concatenate([[0], np.cumsum([len(t[0]) for t in texts])])
    own = [t[0] for t in texts]
    first, woffs = windows(offs)
    stop = np.repeat(offs[1:], np.diff(woffs))
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (y == 0).sum()))
    mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items() if k != "emb"}
    g2 = np.zeros(1 << BITS, np.float32)
    k = 0
    per_epoch = -(-(len(y) + (y == 0).sum()) // batch)
    for epoch in range(max(epochs, -(-steps // per_epoch))):
        logit = np.concatenate(_logits(net, own)) if epoch else rng.random(woffs[-1])
        best = np.array([a + int(np.argmax(logit[a:b])) for a, b in zip(woffs[:-1], woffs[1:], strict=True)])
        some = woffs[:-1] + (rng.random(len(y)) * np.diff(woffs)).astype(int)
        clean = np.flatnonzero(y == 0)
        pick = np.concatenate([best, some[clean]])
        label, wt = np.concatenate([y, y[clean]]), np.concatenate([weight, weight[clean] * 0.5])
        order = rng.permutation(len(pick))
        for lo_ in range(0, len(order), batch):
            o = order[lo_ : lo_ + batch]
            idx = window_index(first[pick[o]], stop[pick[o]], len(x))
            hole = (idx == len(x)) | (rng.random(idx.shape) < drop)
            grad = net.step(x[np.minimum(idx, max(len(x) - 1, 0))], hole, label[o].astype(np.float32), wt[o])
            k += 1
            rows, ge = grad.pop("emb")
            g2[rows] += (ge * ge).sum(1) / DIM
            net.p["emb"][rows] -= 0.015 * ge / (np.sqrt(g2[rows])[:, None] + 1e-6)
            for name, g in grad.items():
                m, v = mom[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[name] -= (rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    a, b = calibrate(np.array([z.max() for z in _logits(net, [t[0] for t in held])], float), np.array([t[1] for t in held]))
    net.p["w"] *= np.float32(a)
    net.p["b"] = (net.p["b"] * a + b).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", per_class: int = SAMPLE_PER_CLASS, words: int = SAMPLE_WORDS) -> Net:
    """Fitted on at most ``per_class`` labelled texts a class, all of them whole; on fewer where these have over ``words`` words."""

    def run(b: pa.RecordBatch):
        for lo, hi, t in pieces(b):
            x, offs = inputs(t)
            part = b.slice(lo, hi - lo)
            out = [x[a:z].tobytes() for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield record(doc_id=part.column("doc_id"), label=part.column("label"), n=np.diff(offs).astype(np.int64), x=pa.array(out, pa.binary()))

    made = labelled(docs, labels, label, keep, per_class).select("doc_id", "text", "label")
    made = saved(map_batches(made, run, "doc_id long, label int, n long, x binary"))
    sizes = made.select("doc_id", "label", "n").collect()
    picked, total = [], {}
    for k in in_hash_order(np.array([r.doc_id for r in sizes], np.int64), 2) if sizes else []:
        r = sizes[k]
        before = total.get(r.label, 0)
        total[r.label] = before + r.n
        if not before or total[r.label] <= words:
            picked.append(r.doc_id)
    if len(picked) < len(sizes):
        made = made.where(F.col("doc_id").isin(picked))
    got = {r.doc_id: (np.frombuffer(r.x, np.uint16).reshape(-1, INPUTS), r.label) for r in made.select("doc_id", "label", "x").collect()}
    return train([got[k] for k in picked])


def scores(t: Texts, net: Net) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of windows of each text."""
    x, offs = inputs(t)
    first, woffs = windows(offs)
    z = net.logits(x, first, np.repeat(offs[1:], np.diff(woffs)))
    top = np.maximum.reduceat(z, woffs[:-1]).astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(top, -30, 30))), np.diff(woffs)


def keep(docs: DataFrame, net: Net, below: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text scores less than ``below``."""

    def run(b: pa.RecordBatch):
        for lo, hi, t in pieces(b):
            yield b.slice(lo, hi - lo).filter(pa.array(scores(t, net)[0] < below))

    return map_batches(docs, run, docs.schema)


def score(docs: DataFrame, net: Net) -> DataFrame:
    """``doc_id, score, n_windows`` of every row, over all overlapping windows."""

    def run(b: pa.RecordBatch):
        for lo, hi, t in pieces(b):
            s, n = scores(t, net)
            yield record(doc_id=b.column("doc_id").slice(lo, hi - lo), score=s, n_windows=n)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, n_windows long")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = fit(docs, labels, crc_mod("doc_id", 5) != 0)
    return score(docs, net).select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
