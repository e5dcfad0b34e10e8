"""Quality rules: decision lists learned by sequential covering.

Statistics of whole texts come from the byte kernel; a learner grows conjunctions
of thresholds on ratios of those statistics (FOIL gain), prunes each on held-back
rows, and emits the list as one ordered Spark ``CASE`` expression.

Defined cases: a null text counts as empty; empty texts have zero statistics (a
ratio over zero is 0); no labels or one class give a list with the default alone;
repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import labelled, map_batches, record, table
from tessera.llm.text import SPACE, U64, Texts, mix, ngrams, owners, pieces

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_pipes", "n_repeat_next"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Ratios that thresholds are learned on, as Spark SQL over STATS.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "pipes_per_word": ("n_pipes", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "repeated_next": ("n_repeat_next", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
}
#: The bound on the sample that is fitted on: documents of each class.
SAMPLE_PER_CLASS = 2000
WINDOW = 8


def per_doc(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order, and whether each key in it equals the one before."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order][1:] == keys[order][:-1]
    return order, same


def statistics(t: Texts) -> dict[str, np.ndarray]:
    starts, ends, woffs = t.words()
    n, own = t.n, owners(woffs)
    out = {"n_words": np.diff(woffs)}
    out["word_chars"] = per_doc(~SPACE[t.buf] & ((t.buf & 0xC0) != 0x80), t.offs)
    out["n_symbols"] = per_doc(_SYMBOL[t.buf], t.offs)
    out["n_upper"] = per_doc((t.buf >= 65) & (t.buf <= 90), t.offs)
    out["n_pipes"] = per_doc(t.buf == 124, t.offs)
    # lines with a word
    ls, le = t.runs(t.buf != 10)
    first = np.searchsorted(starts, ls)
    has = (first < len(starts)) & (np.append(starts, 1 << 62)[first] < le)
    ls, le = ls[has], le[has]
    lown = np.searchsorted(t.offs, ls, side="right") - 1
    out["n_lines"] = np.bincount(lown, minlength=n)
    order, same = _repeats(t.hashes(ls, le, lower=False) ^ mix(lown.astype(np.uint64)))
    out["n_dup_lines"] = np.bincount(lown[order][same], minlength=n)
    # words in windows that are found twice
    h = t.hashes(starts, ends, lower=False)
    g = ngrams(h, WINDOW)
    at = np.flatnonzero(np.arange(len(g)) + WINDOW <= woffs[own[: len(g)] + 1])
    order, same = _repeats(g[at] ^ mix(own[at].astype(np.uint64)))
    twice = same.copy()
    twice[:-1] |= same[1:]
    cover = np.zeros(len(h) + 1, np.int64)
    hit = at[order[twice]]
    cover += np.bincount(hit, minlength=len(cover))
    cover -= np.bincount(hit + WINDOW, minlength=len(cover))
    out["n_repeat_words"] = per_doc(np.cumsum(cover)[: len(h)] > 0, woffs)
    nxt = np.zeros(len(h), bool)
    nxt[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    out["n_repeat_next"] = per_doc(nxt, woffs)
    return {k: out[k].astype(np.int64) for k in STATS}


def with_statistics(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, the columns in ``more``, and STATS of every row."""
    keep = ["doc_id", *more]
    types = dict(docs.dtypes)
    docs = docs.select(*keep, "text")

    def run(b: pa.RecordBatch):
        for lo, hi, t in pieces(b):
            part = b.slice(lo, hi - lo)
            yield record(**{k: part.column(k) for k in keep}, **statistics(t))

    return map_batches(docs, run, ", ".join([f"{k} {types[k]}" for k in keep] + [f"{k} long" for k in STATS]))


def _foil(p0: float, n0: float, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, gain, -np.inf)


def _best_literal(x: np.ndarray, y: np.ndarray, rows: np.ndarray):
    """The threshold of largest gain over the rows: (gain, feature, op, value)."""
    best, p0, n0 = (0.0, None, None, None), float(y[rows].sum()), float((~y[rows]).sum())
    if not p0:
        return best
    for f in range(x.shape[1]):
        o = np.argsort(x[rows, f], kind="stable")
        v, yy = x[rows, f][o], y[rows][o]
        cp, cn = np.cumsum(yy), np.cumsum(~yy)
        cut = np.flatnonzero(v[1:] > v[:-1])
        for op, p, n in ((">", cp[-1] - cp[cut], cn[-1] - cn[cut]), ("<=", cp[cut], cn[cut])):
            if len(cut) and (g := _foil(p0, n0, p.astype(float), n.astype(float))).max() > best[0]:
                k = int(g.argmax())
                best = (float(g[k]), f, op, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    return best


def _covers(rule, x: np.ndarray) -> np.ndarray:
    m = np.ones(len(x), bool)
    for f, op, v in rule:
        m &= x[:, f] > v if op == ">" else x[:, f] <= v
    return m


def learn(x: np.ndarray, bad: np.ndarray, max_rules: int = 12, max_literals: int = 3, least: int = 5, precision: float = 0.9):
    """Ordered conjunctions [(feature, op, value), ...] that reject; the default keeps."""
    rules: list[list[tuple[int, str, float]]] = []
    held = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < max_rules and bad[left].any():
        rule: list[tuple[int, str, float]] = []
        rows = np.flatnonzero(left & ~held)
        while len(rule) < max_literals and (~bad[rows]).any():
            gain, f, op, v = _best_literal(x, bad, rows)
            if f is None:
                break
            rule.append((f, op, v))
            rows = rows[_covers([rule[-1]], x[rows])]
        prune = np.flatnonzero(left & held)

        def worth(r):
            c = _covers(r, x[prune])
            p, n = bad[prune][c].sum(), (~bad[prune][c]).sum()
            return (p - n) / max(p + n, 1), len(r) == 0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        c = _covers(rule, x) & left
        if not rule or bad[c].sum() < least or bad[c].mean() < precision:
            break
        rules.append(rule)
        left &= ~c
    return rules


def ratio(name: str) -> str:
    a, b = RATIOS[name]
    return f"(CASE WHEN {b} > 0 THEN {a} / CAST({b} AS DOUBLE) ELSE 0D END)"


def expression(rules) -> str:
    """The decision list as SQL: true keeps, false rejects."""
    names = list(RATIOS)
    whens = "".join(" WHEN " + " AND ".join(f"{ratio(names[f])} {op} {v!r}D" for f, op, v in r) + " THEN false" for r in rules)
    return f"(CASE{whens} ELSE true END)" if rules else "true"


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS, keep: Column | None = None) -> str:
    """The learned list, from at most ``per_class`` labelled documents of each class."""
    sample = labelled(docs, labels, label, F.lit(True) if keep is None else keep, per_class)
    got = with_statistics(sample, "label").orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    if got.label.nunique() < 2:
        return "true"
    x = np.column_stack([np.where(got[b] > 0, got[a] / np.maximum(got[b], 1), 0.0) for a, b in RATIOS.values()])
    return expression(learn(x, (got.label == 0).to_numpy()))


def judge(docs: DataFrame, rule: str) -> DataFrame:
    s = with_statistics(docs)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return s.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.expr(rule))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rule = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rule).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
