"""Purged walk-forward windows and models over panels."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date as Date

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

C = F.col


@dataclass(frozen=True)
class Fold:
    train: tuple
    valid: tuple
    test: tuple


def walk_forward(dates: list, train: int = 750, valid: int = 60, step: int = 20, purge: int = 5) -> list[Fold]:
    """Windows over sorted dates with ``purge`` dates left out before validation and before test; a short tail is dropped."""
    out, at = [], train + purge + valid + purge
    while at + step <= len(dates):
        v = at - purge - valid
        out.append(Fold(tuple(dates[v - purge - train : v - purge]), tuple(dates[v : v + valid]), tuple(dates[at : at + step])))
        at += step
    return out


def multi_folds(dates: list, folds: int, step: int, train: int = 750, valid: int = 60, horizon: int = 5) -> list[tuple[list, list]]:
    """(training dates, validation dates) from early to late; the last ends ``horizon`` dates before the end, and both are as far apart."""
    out = []
    for k in range(folds):
        end = len(dates) - horizon - k * step
        start = end - valid - horizon
        if start - train < 0:
            raise ValueError("too few dates for so many folds")
        out.append((list(dates[start - train : start]), list(dates[end - valid : end])))
    return out[::-1]


def calendar_windows(first, last, train: int = 5, valid: int = 1, test: int = 1, step: int = 1) -> list[dict]:
    """Windows of whole years, (first day, last day) each, while the test years end within the data."""
    out, year = [], first.year
    while True:
        edges = [year, year + train, year + train + valid, year + train + valid + test]
        spans = [(Date(a, 1, 1), Date(b - 1, 12, 31)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        if spans[2][1] > last:
            return out
        out.append(dict(zip(("train", "valid", "test"), spans, strict=True)))
        year += step


def within(df: DataFrame, span: tuple) -> DataFrame:
    return df.where(F.col("date").between(span[0], span[-1]))


def ridge_predict(df: DataFrame, features: list[str], label: str, folds: list[Fold], alpha: float = 10.0) -> DataFrame:
    """Ridge predictions of each fold's test dates, with an unpenalised intercept.

    The panel is read twice, whatever the number of folds: once for the moments of each
    date, which folds sum, and once to predict.  Only sums of a fold come to the driver.
    """
    spark = df.sparkSession
    full = df.fillna(0.0, features)
    span = spark.createDataFrame([(k, f.train[0], f.train[-1]) for k, f in enumerate(folds)], "fold int, lo date, hi date")
    cols = [*features, label]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    known = full.where(F.col(label).isNotNull())
    day = known.groupBy("date").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in cols], *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in pairs])
    names = [c for c in day.columns if c != "date"]
    sums = day.join(F.broadcast(span), F.col("date").between(F.col("lo"), F.col("hi"))).groupBy("fold").agg(*[F.sum(c).alias(c) for c in names]).collect()
    rows = []
    for r in sums:
        mean = {c: r[f"s_{c}"] / r.n for c in cols}
        m = {(a, b): r[f"p_{a}_{b}"] - r.n * mean[a] * mean[b] for a, b in pairs}
        x = np.array([[m.get((a, b), m.get((b, a))) for b in features] for a in features])
        w = np.linalg.solve(x + alpha * np.eye(len(features)), np.array([m[a, label] for a in features]))
        f = folds[r.fold]
        rows += [(d, [float(v) for v in w], float(mean[label] - sum(v * mean[c] for v, c in zip(w, features, strict=True))), f.train[0], f.train[-1]) for d in f.test]
    by = F.broadcast(spark.createDataFrame(rows, "date date, _w array<double>, _b double, train_start date, train_end date"))
    pred = sum((F.col("_w")[k] * F.col(c) for k, c in enumerate(features)), F.col("_b"))
    return full.select("symbol", "date", *features).join(by, "date").select("symbol", "date", pred.alias("pred"), "train_start", "train_end")


def rolling_predict(df: DataFrame, features: list[str], label: str, folds: list[Fold], kind: str = "ridge", alpha: float = 10.0, **kw) -> DataFrame:
    """Predictions of each fold's test dates by a model fitted on its training dates."""
    if kind == "ridge":
        return ridge_predict(df, features, label, folds, alpha)
    full = VectorAssembler(inputCols=features, outputCol="features").transform(df.fillna(0.0, features)).persist(StorageLevel.DISK_ONLY)
    out = None
    for f in folds:
        t = within(full, f.train).where(F.col(label).isNotNull())
        if kind == "mlp":
            p = _mlp_fold(t, within(full, f.test), features, label, **kw)
        else:
            model = GBTRegressor(labelCol=label, seed=7, **({"maxIter": 8, "maxDepth": 3} | kw)).fit(t)
            p = model.transform(within(full, f.test)).select("symbol", "date", F.col("prediction").alias("pred"))
        p = p.withColumns({"train_start": F.lit(f.train[0]), "train_end": F.lit(f.train[-1])})
        out = p if out is None else out.unionByName(p)
    return out


def ic_weights(summary: DataFrame) -> DataFrame:
    """Weights by mean rank IC that sum to 1 in absolute value: (factor, weight)."""
    total = F.sum(F.abs("mean")).over(Window.partitionBy())
    return summary.select("factor", (F.col("mean") / total).alias("weight"))


#: Rows that one copy of the network is fitted on; copies of all rows' shares are averaged after each round.
MLP_ROWS, MLP_ROUNDS = 200_000, 3


def fit_mlp(x: np.ndarray, y: np.ndarray, mean: np.ndarray, sd: np.ndarray, hidden=(64, 32), delta: float = 0.05, epochs: int = 12, batch: int = 512, rate: float = 1e-3, decay: float = 1e-4, patience: int = 4, seed: int = 7, start=None):
    """A rectified network with Huber loss and decoupled weight decay; the last tenth of rows stops it early.

    ``mean`` and ``sd`` of the features are those of all rows; ``start`` are layers to go on from.  Gives the layers.
    """
    rng = np.random.default_rng(seed)
    x = np.clip((x - mean) / sd, -5, 5)
    sizes = [x.shape[1], *hidden, 1]
    ws = [[rng.standard_normal((a, b)) * (2 / a) ** 0.5, np.zeros(b)] for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
    ws = [list(layer) for layer in start] if start else ws
    mom = [[[np.zeros_like(p), np.zeros_like(p)] for p in w] for w in ws]
    cut = max(1, len(x) * 9 // 10)
    best, kept, bad, k = np.inf, ws, 0, 0

    def forward(z, layers):
        acts = [z]
        for i, (w, b) in enumerate(layers):
            z = z @ w + b
            z = np.maximum(z, 0) if i < len(layers) - 1 else z
            acts.append(z)
        return acts

    for _ in range(epochs):
        order = rng.permutation(cut)
        for lo in range(0, cut, batch):
            o = order[lo : lo + batch]
            acts = forward(x[o], ws)
            g = np.clip(acts[-1][:, 0] - y[o], -delta, delta)[:, None] / len(o)
            k += 1
            for i in range(len(ws) - 1, -1, -1):
                grads = acts[i].T @ g, g.sum(0)
                g = (g @ ws[i][0].T) * (acts[i] > 0)
                for j, d in enumerate(grads):
                    m, v = mom[i][j]
                    m += 0.1 * (d - m)
                    v += 0.001 * (d * d - v)
                    ws[i][j] = ws[i][j] * (1 - rate * decay) - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        e = np.abs(forward(x[cut:], ws)[-1][:, 0] - y[cut:])
        loss = float(np.where(e < delta, e * e / 2, delta * (e - delta / 2)).mean()) if len(e) else 0.0
        if loss < best - 1e-9:
            best, kept, bad = loss, [list(w) for w in ws], 0
        else:
            bad += 1
            if bad >= patience:
                break
    return kept


def apply_mlp(layers, x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / sd, -5, 5)
    for i, (w, b) in enumerate(layers):
        z = z @ w + b
        z = np.maximum(z, 0) if i < len(layers) - 1 else z
    return z[:, 0]


def _mlp_fold(train: DataFrame, test: DataFrame, features: list[str], label: str, **kw) -> DataFrame:
    """Rows are dealt to shares by a hash of their key; each share trains a copy from the same start, and copies are averaged by rows."""
    stats = train.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in features for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not stats.n:
        return test.select("symbol", "date", F.lit(None).cast("double").alias("pred"))
    mean, sd = np.array([stats[f"m_{c}"] for c in features]), np.array([stats[f"s_{c}"] for c in features]) + 1e-9
    shares = -(-stats.n // MLP_ROWS)

    epochs = kw.pop("epochs", 12)

    def learner(layers):
        def learn(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["_o", "symbol", "date"])
            new = fit_mlp(pdf[features].to_numpy(float), pdf[label].to_numpy(float), mean, sd, epochs=-(-epochs // MLP_ROUNDS), start=layers, **kw)
            return pd.DataFrame({"n": [float(len(pdf))], "v": [np.concatenate([p.ravel() for layer in new for p in layer]) * len(pdf)], "sizes": [[layer[0].shape[1] for layer in new]]})

        return learn

    o = F.xxhash64("symbol", "date")
    dealt = train.select("symbol", "date", *features, label, o.alias("_o"), F.pmod(o, F.lit(shares)).alias("_g")).persist(StorageLevel.DISK_ONLY)
    layers = None
    for _ in range(MLP_ROUNDS):
        copies = dealt.groupBy("_g").applyInPandas(learner(layers), "n double, v array<double>, sizes array<int>")
        # the places of the network, summed over the copies on the executors
        total = copies.select("n", "sizes", F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.first("sizes").alias("sizes")).orderBy("k").collect()
        flat, at, layers, width = np.array([r.x / r.n for r in total]), 0, [], len(features)
        for out in total[0].sizes:
            w = flat[at : at + width * out].reshape(width, out)
            at += width * out
            layers.append((w, flat[at : at + out]))
            at, width = at + out, out
    dealt.unpersist()

    def run(batches):
        for pdf in batches:
            yield pdf[["symbol", "date"]].assign(pred=apply_mlp(layers, pdf[features].to_numpy(float), mean, sd))

    kinds = dict(test.dtypes)
    return test.select("symbol", "date", *features).mapInPandas(run, f"symbol {kinds['symbol']}, date {kinds['date']}, pred double")


def shrunk_covariance(df: DataFrame, name: str, time: str, value: str, periods: float = 252.0, least: int = 40) -> DataFrame:
    """``name, other, covariance``: Ledoit-Wolf covariance towards a scaled identity, annualised.

    Rows missing a name take its median; under ``least`` rows the matrix is diagonal.
    Moments of pairs of names are one aggregate over (time, pair).
    """
    names, times = df.select(C(name).alias("i")).distinct(), df.select(C(time).alias("t")).distinct()
    mid = df.groupBy(C(name).alias("i")).agg(F.percentile(value, F.lit(0.5)).alias("mid"))
    x = df.select(C(name).alias("i"), C(time).alias("t"), C(value).alias("v"))
    # the grid of names and times: as large as the full matrix of returns
    every = times.withColumn("i", F.explode(F.lit([r.i for r in names.orderBy("i").collect()])))
    x = every.join(x, ["i", "t"], "left").join(F.broadcast(mid), "i").withColumn("v", F.coalesce("v", "mid"))
    x = x.withColumn("a", C("v") - F.avg("v").over(Window.partitionBy("i"))).select("i", "t", "a")
    y = x.select(C("i").alias("j"), "t", C("a").alias("b"))
    m = x.join(y, "t").groupBy("i", "j").agg(F.count("*").alias("n"), F.avg(C("a") * C("b")).alias("s"), F.avg(C("a") * C("a") * C("b") * C("b")).alias("q"))
    same = (C("i") == C("j")).cast("double")
    k = F.sqrt(F.count("*").over(Window.partitionBy()))
    m = m.withColumns({"same": same, "k": k, "mu": F.sum(C("s") * same).over(Window.partitionBy()) / k})
    all_ = Window.partitionBy()
    m = m.withColumns({"d2": F.sum((C("s") - C("mu") * C("same")) ** 2).over(all_) / C("k"), "b2": F.sum(C("q") - C("s") * C("s")).over(all_) / (C("n") * C("k"))})
    share = F.when(C("d2") > 0, F.least("b2", "d2") / C("d2")).otherwise(1.0)
    shrunk = F.when(C("n") < least, C("s") * C("same")).otherwise(share * C("mu") * C("same") + (1 - share) * C("s"))
    return m.select(C("i").alias("name"), C("j").alias("other"), (shrunk * periods).alias("covariance"))


def minimum_variance(covariance: DataFrame) -> DataFrame:
    """Adds ``weight``, the long-only minimum-variance weight of ``name``: a universe of some hundred names is one matrix."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.pivot(index="name", columns="other", values="covariance").sort_index()
        c = c[c.index]
        w = _minimum_variance(c.to_numpy(float))
        return pdf.assign(weight=pdf["name"].map(dict(zip(c.index, w, strict=True))))[["name", "other", "covariance", "weight"]]

    kind = dict(covariance.dtypes)["name"]
    return covariance.groupBy().applyInPandas(run, f"name {kind}, other {kind}, covariance double, weight double")


def _minimum_variance(c: np.ndarray, rounds: int = 2000) -> np.ndarray:
    k = len(c)
    w = 1 / np.maximum(np.diag(c), 1e-12)
    w /= w.sum()
    step = 1 / (np.linalg.eigvalsh(c).max() + 1e-12)
    for _ in range(rounds):
        v = np.sort(w - step * (c @ w))[::-1]
        theta = ((np.cumsum(v) - 1) / np.arange(1, k + 1))[np.flatnonzero(v - (np.cumsum(v) - 1) / np.arange(1, k + 1) > 0)[-1]]
        w = np.maximum(w - step * (c @ w) - theta, 0)
    return w
