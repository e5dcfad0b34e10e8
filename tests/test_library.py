"""Joins, statistics, portfolios, documents, registry, streams."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import factors, registry  # noqa: F401
from tessera.operators import evaluation, joins, models
from tessera.operators import portfolio as pf
from tessera.operators import statistics as st
from tessera.panel import Panel
from tessera.sources import documents as docs
from tessera.streaming import events as ev

D0 = dt.date(2024, 1, 1)
day = lambda k: D0 + dt.timedelta(k)


def test_as_of_keeps_null_payloads(spark):
    left = spark.createDataFrame([("a", day(k)) for k in range(4)] + [("b", day(1))], "k string, t date")
    right = spark.createDataFrame([("a", day(1), 1.0), ("a", day(2), None)], "k string, u date, v double")
    got = {(r.k, r.t): (r.u, r.v) for r in joins.as_of(left, right, "k", "t", "u").collect()}
    assert got == {("a", day(0)): (None, None), ("a", day(1)): (day(1), 1.0), ("a", day(2)): (day(2), None), ("a", day(3)): (day(2), None), ("b", day(1)): (None, None)}


def test_intervals(spark):
    left = spark.createDataFrame([("a", day(k)) for k in range(1, 4)], "k string, t date")
    iv = spark.createDataFrame([("a", day(2), day(3), "x")], "k string, s date, e date, v string")
    half = joins.as_of_valid(left, iv, "k", "t", "s", "e").orderBy("t").collect()
    assert [r.v for r in half] == [None, "x", None]
    assert [r.v for r in joins.as_of_valid(left, iv, "k", "t", "s", "e", closed=True).orderBy("t").collect()] == [None, "x", "x"]


def test_pit_events_drop_stale_revisions(spark):
    q1, q2 = dt.date(2023, 9, 30), dt.date(2023, 12, 31)
    rows = [("a", day(1), q1, 1), ("a", day(5), q2, 2), ("a", day(9), q1, 3), ("a", dt.date(2023, 1, 1), q2, 4), ("a", None, q1, 5)]
    got = joins.pit_events(spark.createDataFrame(rows, "k string, ann date, per date, id int"), "k", "ann", "per", ("id",)).orderBy("ann").collect()
    assert [(r.id, r.report_seq) for r in got] == [(1, 0), (2, 1)]


def test_upsert_and_fill(spark):
    old = spark.createDataFrame([(1, "a", 0)], "id int, v string, seq int")
    new = spark.createDataFrame([(1, "b", 1), (2, "c", 1)], "id int, v string, seq int")
    assert sorted((r.id, r.v) for r in joins.upsert(old, new, ["id"], [F.desc("seq")]).collect()) == [(1, "b"), (2, "c")]


def test_student_t():
    assert st.student_t_sf(0, 10) == pytest.approx(1)
    assert st.student_t_sf(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert st.student_t_sf(-12.706204736, 1) == pytest.approx(0.05, abs=1e-8)
    assert st.student_t_sf(1.959963985, 1e7) == pytest.approx(0.05, abs=1e-5)


def test_bh(spark):
    p = [0.01, 0.04, 0.03, 0.2]
    df = spark.createDataFrame([(str(k), x) for k, x in enumerate(p)], "key string, p double")
    got = {r.key: r.q for r in st.benjamini_hochberg(df, "p", "key").collect()}
    assert [got[str(k)] for k in range(4)] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.2])


def test_hac_error_exceeds_naive(spark):
    rng = np.random.default_rng(7)
    x, rows = 0.0, []
    for k in range(500):
        x = 0.9 * x + rng.normal()
        rows.append(("f", day(k), float(x)))
    df = spark.createDataFrame(rows, "factor string, date date, v double")
    r = st.newey_west(df, "v", "date", "factor", 19).first()
    assert r.se > 1.5 * np.std([v for *_, v in rows], ddof=1) / math.sqrt(500)


def test_greedy_prune():
    got = st.greedy_prune(["a", "b", "c"], {"a": 0.3, "b": 0.2, "c": 0.1}, {("a", "b"): 0.8, ("a", "c"): 0.1, ("b", "c"): 0.9}, 0.7)
    assert [(f, k, m) for f, k, m, _ in got] == [("a", True, None), ("b", False, "a"), ("c", True, "a")]
    assert st.effective_dimension(np.eye(4)) == pytest.approx(4)


def test_quantile_groups_match_pandas(spark):
    n = 23
    df = spark.createDataFrame([(f"s{k:02d}", D0, float((k * 7) % n)) for k in range(n)], "symbol string, date date, x double")
    got = {r.symbol: r.grp for r in st.quantile_groups(df, "x", 5).collect()}
    x = pd.Series({f"s{k:02d}": (k * 7) % n for k in range(n)})
    assert got == pd.qcut(x.rank(method="first"), 5, labels=False).astype(int).to_dict()


def test_week_schedule_skips_holidays(spark):
    days = [dt.date(2024, 4, k) for k in (1, 2, 3, 8, 9)]
    got = pf.week_schedule(spark.createDataFrame([(d,) for d in days], "date date")).collect()
    assert [tuple(r) for r in got] == [(dt.date(2024, 4, 3), dt.date(2024, 4, 8))]


def test_selection_with_buffer_and_cap():
    scores = [(f"s{k}", 10.0 - k, f"g{k % 2}") for k in range(8)]
    assert pf.select_with_buffer(scores, set(), 4, 6, 2) == ["s0", "s1", "s2", "s3"]
    assert pf.select_with_buffer(scores, {"s5", "s7"}, 4, 6, 4) == ["s5", "s0", "s1", "s2"]
    assert pf.select_with_buffer(scores, {"s6", "s7"}, 4, 6, 4, drop=1)[0] == "s6"
    assert pf.select_with_buffer(scores[::-1], set(), 3, 6, 3) == ["s0", "s1", "s2"]


def _market(symbols=20, n=6, price=10.0, drift=0.0):
    rows = [("x", day(k), f"s{s:02d}", price * (1 + drift * s) ** k, price * (1 + drift * s) ** k, 1e6, float(s), f"g{s % 5}", False, False) for k in range(n) for s in range(symbols)]
    return pd.DataFrame(rows, columns=["scenario", "date", "symbol", "open", "close", "volume", "score", "grp", "no_buy", "no_sell"])


def test_flat_market_keeps_value():
    nav = pf.daily_engine(_market(), pf.Rules(rate=0, fee=0, every=2))
    assert nav.equity.tolist() == [1e7] * 6
    assert nav.n_holdings.tolist()[0] == 0 and nav.n_holdings.tolist()[1] > 0  # decided at the close, filled at the next open
    assert pf.weekly_engine(_market(), bps=0).equity.tolist() == pytest.approx([1.0] * 6)


def test_engines_pay_and_respect_limits():
    m = _market(30, 8, drift=0.001)
    r = pf.Rules(k=10, buffer=12, cap=3, every=2)
    nav = pf.daily_engine(m, r)
    assert nav.cost.sum() > 0 and nav.n_holdings.max() <= 10
    later = nav[nav.rebalanced].iloc[1:]
    assert (later.turnover <= r.turnover + 1e-9).all()
    m["no_buy"] = True
    assert pf.daily_engine(m, r).n_holdings.max() == 0
    assert pf.weekly_engine(_market(30, 8, drift=0.001), bps=10).equity.iloc[-1] > 1


def test_simulations_side_by_side(spark):
    a = _market()
    df = spark.createDataFrame(pd.concat([a, a.assign(scenario="y")]))
    got = pf.simulate(df, pf.daily_engine, pf.Rules(rate=0, fee=0)).groupBy("scenario").count().collect()
    assert {r.scenario: r["count"] for r in got} == {"x": 6, "y": 6}


def test_performance(spark):
    nav = spark.createDataFrame([("a", day(k), v) for k, v in enumerate([1.0, 1.1, 0.99, 1.2])], "s string, date date, nav double")
    r = pf.performance(nav, "s", "nav", "date", 52.0).first()
    assert r.total == pytest.approx(0.2) and r.max_dd == pytest.approx(0.1) and r.periods == 3


def test_walk_forward_is_purged():
    folds = models.walk_forward(list(range(400)), 100, 20, 30, 5)
    assert folds
    for f in folds:
        assert f.train[-1] + 5 < f.valid[0] and f.valid[-1] + 5 < f.test[0] and len(f.train) == 100 and len(f.test) == 30
    assert models.walk_forward(list(range(50)), 100) == []


def test_registry():
    n = registry.summary()
    assert n["composite"] == 6 and n["external"] == 158 and sum(n.values()) - 158 - 6 == 112
    with pytest.raises(ValueError):
        registry.register("REV5", "volatility", [], None)
    with pytest.raises(ValueError):
        registry.register("NEW", "nonsense", [], None)


def test_missing_inputs(spark):
    p = Panel(spark.createDataFrame([("a", D0, 1.0)], "symbol string, date date, close double"))
    assert registry.compute(p, ["EP"]).first().EP is None
    with pytest.raises(ValueError):
        registry.compute(p, ["EP"], strict=True)


RSS = """<?xml version="1.0"?><rss><channel><item><title>A</title><link>http://x/1</link><guid>1</guid>
<pubDate>Mon, 01 Jan 2024 08:00:00 +0800</pubDate><description>text</description></item></channel></rss>"""


def test_feeds_and_json(spark, tmp_path):
    (tmp_path / "f.xml").write_text(RSS)
    r = docs.read_feeds(spark, str(tmp_path / "f.xml"), "s").first()
    assert (r.title, r.external_id, str(r.published_at)) == ("A", "1", "2024-01-01 00:00:00")
    with pytest.raises(ValueError):
        docs.parse_feed("<!DOCTYPE html><html>verify you are human</html>", "s")
    (tmp_path / "l.json").write_text('[{"h": "T", "b": "B"}, {"h": "U"}]')
    got = docs.read_json_list(spark, str(tmp_path / "l.json"), {"title": "h", "content": "b", "source_url": "u"}, "j").collect()
    assert [(r.title, r.content, r.source_url) for r in got] == [("T", "B", None), ("U", None, None)]


def test_document_identity(spark):
    df = spark.createDataFrame([(1, "s", None, None, "a  b\0"), (2, "s", None, " ", " a b"), (3, "t", None, None, "a b"), (4, "s", "e", None, "c")], "id int, source string, external_id string, source_url string, content string")
    got = docs.dedup_documents(docs.identified(df), [F.col("id")])
    assert sorted(r.id for r in got.collect()) == [1, 3, 4]
    assert docs.identified(df).select("document_id").distinct().count() == 3


def test_stream_dedup(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([(f"e{j}", dt.datetime(2024, 1, 1, j), "t", 1.0) for j in range(3)], "id string, ts timestamp, kind string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("id string, ts timestamp, kind string, value double").parquet(str(tmp_path / "in"))
    q = ev.dedup(src, "id", "ts", "1 day").writeStream.format("memory").queryName("dedup_test").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("dedup_test").count() == 3


def test_network_learns_from_shares_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(models, "MLP_ROWS", 400)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 2))
    rows = [(k, day(k % 60), float(a), float(b), float(0.3 * a - 0.2 * b)) for k, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol long, date date, a double, b double, y double")
    fold = models.Fold(tuple(day(k) for k in range(50)), (), tuple(day(k) for k in range(50, 60)))
    got = models.rolling_predict(df, ["a", "b"], "y", [fold], "mlp", epochs=20, rate=3e-3).join(df, ["symbol", "date"]).toPandas()
    assert len(got) == 250 and np.corrcoef(got.pred, got.y)[0, 1] > 0.95


def test_ridge_equals_normal_equations(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 2))
    y = x @ [0.5, -1.0] + 0.3 + 0.1 * rng.normal(size=900)
    df = spark.createDataFrame([(k, day(k % 30), float(a), float(b), float(v)) for k, ((a, b), v) in enumerate(zip(x, y))], "symbol long, date date, a double, b double, y double")
    folds = models.walk_forward([day(k) for k in range(30)], 10, 4, 5, 1)
    got = models.ridge_predict(df, ["a", "b"], "y", folds, 10.0).toPandas()
    at = np.arange(900) % 30
    for f in folds:
        lo, hi = (f.train[0] - day(0)).days, (f.train[-1] - day(0)).days
        t = (at >= lo) & (at <= hi)
        m, c = x[t].mean(0), y[t].mean()
        w = np.linalg.solve((x[t] - m).T @ (x[t] - m) + 10 * np.eye(2), (x[t] - m).T @ (y[t] - c))
        part = got[got.date.isin(f.test)].sort_values("symbol")
        assert len(part) == 150 and np.allclose(part.pred, (x[part.symbol] - m) @ w + c)


def test_mean_variance_weights():
    """Against a fine grid of all allowed weights of three names, with and without a bound on turnover."""
    rng = np.random.default_rng(4)
    for bound in (None, 0.4):
        a = rng.normal(size=3) * 0.02
        m = rng.normal(size=(3, 3)) * 0.1
        cov, before = m @ m.T + 0.01 * np.eye(3), np.array([0.5, 0.3, 0.2])
        kw = dict(exposure=1.0, risk=2.0, penalty=0.01, most=0.7, industry_most=0.8, turnover=bound)
        w = evaluation.mean_variance(a, cov, before, np.array(["x", "x", "y"]), **kw)
        value = lambda v: a @ v - 2.0 * v @ cov @ v - 0.01 * np.abs(v - before).sum()
        grid = [np.array([i, j, 200 - i - j]) / 200 for i in range(201) for j in range(201 - i)]
        grid = [v for v in grid if v.max() <= 0.7 and v[0] + v[1] <= 0.8 and (bound is None or np.abs(v - before).sum() <= bound + 1e-9)]
        assert abs(w.sum() - 1) < 1e-9 and w.min() >= 0 and w.max() <= 0.7 + 1e-4 and w[0] + w[1] <= 0.8 + 1e-4
        assert bound is None or np.abs(w - before).sum() <= bound + 1e-4
        assert value(w) >= max(map(value, grid)) - 2e-4


def test_network_and_covariance(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = 0.3 * x[:, 0] - 0.2 * np.maximum(x[:, 1], 0)
    mean, sd = x.mean(0), x.std(0)
    layers = models.fit_mlp(x, y, mean, sd, epochs=30, rate=3e-3)
    assert np.corrcoef(models.apply_mlp(layers, x, mean, sd), y)[0, 1] > 0.97
    rows = [(f"n{k}", day(t), float(v)) for t in range(80) for k, v in enumerate(rng.normal(size=3) * [1.0, 0.1, 3.0])]
    got = models.minimum_variance(models.shrunk_covariance(spark.createDataFrame(rows, "name string, date date, v double"), "name", "date", "v")).toPandas()
    c = got.pivot(index="name", columns="other", values="covariance").to_numpy()
    w = got.groupby("name").weight.first().to_numpy()
    assert np.allclose(c, c.T) and np.linalg.eigvalsh(c).min() > 0
    free = np.linalg.solve(c, np.ones(3))
    assert (free > 0).all() and np.allclose(w, free / free.sum(), atol=2e-3)


def test_engines_stream_days_and_agree_with_a_scenario_in_one_table(spark):
    import pandas as pd

    two = pd.concat([_market().assign(scenario=k) for k in ("a", "b")]).sample(frac=1, random_state=1)
    df = spark.createDataFrame(two).repartition(3)
    for engine, args in ((pf.daily_engine, (pf.Rules(every=2),)), (pf.weekly_engine, ())):
        plan = pf.simulate(df, engine, *args)
        assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().toString()  # which holds a scenario in one table
        got = plan.toPandas().sort_values(["scenario", "date"]).reset_index(drop=True)
        want = pd.concat([engine(g, *args) for _, g in two.groupby("scenario")]).reset_index(drop=True)
        pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_a_day_that_batches_split_is_one_day():
    import datetime as dt

    import numpy as np
    import pyarrow as pa

    rows = [(s, dt.date(2020, 1, d), k) for s in "ab" for d in (1, 2) for k in range(5)]
    t = pa.table({c: [r[i] for r in rows] for i, c in enumerate(("scenario", "date", "symbol"))}).cast(pa.schema([("scenario", pa.string()), ("date", pa.date32()), ("symbol", pa.int64())]))
    for size in (1, 3, 5, 7, 20):
        got = [(s, d, v["symbol"]) for s, d, v in pf.each_day(t.to_batches(max_chunksize=size))]
        assert [x[:2] for x in got] == [(s, dt.date(2020, 1, d)) for s in "ab" for d in (1, 2)]
        assert all(np.array_equal(x[2], np.arange(5)) for x in got)


def test_rolling_families_stream_and_leave_out_nulls(spark):
    import numpy as np

    from tessera.functions import rolling
    from tessera.functions.factors import FAMILIES

    rng = np.random.default_rng(2)
    rows = [(s, k, *(None if rng.random() < 0.1 and s else float(x) for x in rng.integers(1, 30, 4))) for s in range(4) for k in range(40)]
    df = spark.createDataFrame(rows, "symbol long, date int, close double, high double, low double, volume double").repartition(3)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    got = {}
    for size in (7, 10000):  # symbols go on over batches
        spark.conf.set(key, size)
        out = rolling.rolled(df, "symbol", "date", 5, "r_", FAMILIES)
        assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
        got[size] = sorted(map(tuple, out.collect()), key=lambda r: r[:2])
    spark.conf.unset(key)
    assert got[7] == got[10000]
    for r in got[7]:
        last = [x for x in rows if x[0] == r[0] and r[1] - 5 < x[1] <= r[1]]
        closes = [x[2] for x in last if x[2] is not None]
        at = dict(zip(FAMILIES, r[6:], strict=True))
        if r[2] is None:
            assert at["MA"] is None
        else:
            assert at["MA"] == pytest.approx(np.mean(closes) / r[2]) and at["QTLU"] == pytest.approx(np.quantile(closes, 0.8) / r[2])
            assert at["RANK"] == pytest.approx((sum(c < r[2] for c in closes) + (closes.count(r[2]) + 1) / 2) / len(closes))
            assert (at["STD"] is None) == (len(closes) < 2)
        highs = [x[3] for x in last if x[3] is not None]
        assert at["IMAX"] == (pytest.approx((highs.index(max(highs)) + 1) / 5) if highs else None)
