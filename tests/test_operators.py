"""Hand-computed vectors and metamorphic properties of the panel operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import crosssection as cs
from tessera.operators import dsl, joins
from tessera.operators import timeseries as ts
from tessera.panel import Panel

D0 = dt.date(2024, 1, 1)
C = F.col


def panel(spark, series, **more):
    """One row a day; ``series`` maps symbols to lists."""
    n = max(len(v) for v in series.values())
    rows = []
    for s, vals in series.items():
        for k, v in enumerate(vals):
            rows.append((s, D0 + dt.timedelta(k), None if v is None else float(v), *[x[s][k] if isinstance(x[s][k], dt.date) else None if x[s][k] is None else float(x[s][k]) for x in more.values()]))
    assert n
    kinds = ", ".join(f"{k} {'date' if k == 'report_period' else 'double'}" for k in more)
    return Panel(spark.createDataFrame(rows, "symbol string, date date, x double" + (", " + kinds if kinds else "")))


def values(p, col, symbol="a"):
    rows = p.select(v=col).where(C("symbol") == symbol).orderBy("date").collect()
    return [r.v for r in rows]


def one(spark, vals, f, **more):
    p = panel(spark, {"a": vals}, **{k: {"a": v} for k, v in more.items()})
    return values(p, f(p))


def test_gaps_are_not_bridged(spark):
    assert one(spark, [1, None, 2], lambda p: ts.pct_change(p, C("x"), 1)) == [None, None, None]
    assert one(spark, [1, None, 2], lambda p: ts.padded_pct_change(p, C("x"), 1)) == [None, 0, 1]


def test_full_windows(spark):
    assert one(spark, [1, 2, 3, None, 5], lambda p: ts.mean(p, C("x"), 2)) == [None, 1.5, 2.5, None, None]
    assert one(spark, [1, 2, 3], lambda p: ts.mean(p, C("x"), 3, 1)) == [1, 1.5, 2]


def test_position_is_not_rank(spark):
    assert one(spark, [1, 3, 2], lambda p: ts.position(p, C("x"), 3))[2] == 0.5
    assert one(spark, [1, 3, 2], lambda p: ts.rank_pct(p, C("x"), 3))[2] == pytest.approx(2 / 3)
    assert one(spark, [2, 2, 2], lambda p: ts.position(p, C("x"), 3))[2] == 0.5


def test_division_and_domains(spark):
    assert one(spark, [1, 1, None], lambda p: ts.safe_div(C("x"), C("y")), y=[0.0, 2.0, 3.0]) == [None, 0.5, None]
    assert one(spark, [-2, -1, 0, 3, None], lambda p: ts.log1p(C("x"))) == [None, None, 0, pytest.approx(math.log(4)), None]
    assert one(spark, [-2, 0, 4, None], lambda p: ts.sqrt(C("x"))) == [None, 0, 2, None]
    assert one(spark, [1, -1, None], lambda p: ts.where(C("x") > 0, F.lit(1.0), F.lit(-1.0))) == [1, -1, None]
    assert one(spark, [1, 5, None], lambda p: ts.clip(C("x"), 2, 4)) == [2, 4, None]
    with pytest.raises(ValueError):
        ts.clip(C("x"), 4, 2)


def test_symbols_do_not_mix(spark):
    p = panel(spark, {"a": [1, 2], "b": [100, 200]})
    col = ts.delta(p, C("x"), 1)
    assert values(p, col, "a") == [None, 1] and values(p, col, "b") == [None, 100]


def test_cross_section(spark):
    p = panel(spark, {"a": [1, 10], "b": [3, 20], "c": [3, None]})
    assert [values(p, cs.rank(p, C("x")), s)[0] for s in "abc"] == pytest.approx([1 / 3, 2.5 / 3, 2.5 / 3])
    z = cs.zscore(p, C("x"))
    assert values(p, z, "a")[1] + values(p, z, "b")[1] == pytest.approx(0)


def test_constants(spark):
    assert one(spark, [1, 1, 1], lambda p: ts.rsquare(p, C("x"), C("y"), 3), y=[1.0, 2.0, 3.0])[2] is None
    assert one(spark, [1] * 5, lambda p: ts.skew(p, C("x"), 5))[4] == 0
    assert one(spark, [1] * 5, lambda p: ts.kurt(p, C("x"), 5))[4] == -3


def test_cov_mad_ewm(spark):
    x = [1, 2, 3, None, 5, 6, 7]
    assert one(spark, x, lambda p: ts.cov(p, C("x"), C("y"), 3), y=[2.0, 4, 6, 8, 10, 12, 14])[2] == pytest.approx(2)
    assert one(spark, x, lambda p: ts.mad(p, C("x"), 3))[2] == pytest.approx(2 / 3)
    e = one(spark, x, lambda p: ts.ewm_mean(p, C("x"), 3))
    assert e[2] == pytest.approx(2.25) and e[3:6] == [None] * 3 and e[6] == pytest.approx(6.25)


@pytest.mark.parametrize("alpha", [1.0, 2 / 3, 1 / 3, 0.2, 2 / 27])
def test_exponential_means_over_long_series(spark, alpha):
    import numpy as np

    rng = np.random.default_rng(3)
    x = [None, None, *(float(v) for v in rng.normal(5, 2, 900))]
    x[300] = None
    got, y = one(spark, x, lambda p: ts.ewm_plain(p, C("x"), alpha)), None
    for v, g in zip(x, got, strict=True):
        y = v if y is None else y if v is None else y * (1 - alpha) + v * alpha
        assert g is y is None or math.isclose(g, y, rel_tol=1e-11)
    assert one(spark, [3, None, 4], lambda p: ts.ewm_mean(p, C("x"), 1)) == [3, None, 4]


def test_value_runs_and_quantiles(spark):
    import numpy as np

    from tessera.operators import statistics as st

    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in rng.normal(size=3000)] + [("b", float(v)) for v in rng.integers(0, 3, 2000)] + [("c", 1.5), ("c", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    qs = (0.0, 0.01, 0.3, 0.5, 0.95, 1.0)
    got = {r.g: r for r in st.exact_quantiles(df, "x", ["g"], qs).collect()}
    assert set(got) == set("abc")
    for g, r in got.items():
        vals = [v for k, v in rows if k == g and v is not None]
        assert r.n == len(vals) and np.allclose(r.q, np.quantile(vals, qs), rtol=0, atol=1e-12)
    runs = {r.x: r for r in st.value_runs(df, "x", []).collect()}
    vals = sorted(v for _, v in rows if v is not None)
    assert len(runs) == len(set(vals)) and all(r.before == np.searchsorted(vals, v) and r.c == vals.count(v) and r.n == len(vals) for v, r in list(runs.items())[::50])
    assert st.value_runs(df.where("x > 99"), "x", []).isEmpty()


def test_counts(spark):
    f = lambda g: one(spark, [1, 1, 0, 1, 1, 1], lambda p: g(p, C("x") > 0, 3))
    assert f(ts.count) == [None, None, 2, 2, 2, 3]
    assert f(ts.consecutive_count) == [None, None, 0, 1, 2, 3]


def test_slope_decay_drawdown(spark):
    assert one(spark, [1, 3, 5], lambda p: ts.slope(p, C("x"), 3))[2] == pytest.approx(2)
    assert one(spark, [1, 2, 6], lambda p: ts.decay_linear(p, C("x"), 3))[2] == pytest.approx((1 + 4 + 18) / 6)
    assert one(spark, [8, 9, 10], lambda p: ts.path_drawdown(p, C("x"), 3))[2] == 0
    assert one(spark, [10, 8, 9], lambda p: ts.path_drawdown(p, C("x"), 3))[2] == pytest.approx(0.2)


def test_report_lag(spark):
    q = [dt.date(2023, 3, 31), dt.date(2023, 6, 30), dt.date(2023, 9, 30)]
    got = one(spark, [10, 11, 20, 20, 30], lambda p: joins.report_lag(p, C("x")), report_period=[q[0], q[0], q[1], q[1], q[2]])
    assert got == [None, None, 11, 11, 20]
    got = one(spark, [10, 11, 20, 20, 30], lambda p: joins.report_delta(p, C("x")), report_period=[q[0], q[0], q[1], q[1], q[2]])
    assert got[2] == 9
    assert one(spark, [10, None, 30], lambda p: joins.report_lag(p, C("x")), report_period=q) == [None, 10, None]
    assert one(spark, [10, 11, 20, 20, 30], lambda p: joins.report_lag(p, C("x"), 2), report_period=[q[0], q[0], q[1], q[1], q[2]]) == [None, None, None, None, 11]


def test_windows_are_checked():
    for bad in (0, -1, True, 2.0):
        with pytest.raises(ValueError):
            ts.rolling(Panel(None), "x", bad, F.avg)


def test_neutralize_is_orthogonal(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(f"s{k}", D0, float(rng.normal()), f"g{k % 4}", float(rng.normal())) for k in range(60)] + [("n", D0, 5.0, None, 1.0)]
    p = Panel(spark.createDataFrame(rows, "symbol string, date date, x double, g string, m double"))
    got = p.select(v=cs.neutralize(p, C("x"), C("m"), C("g")))
    pdf = got.join(p.df.select("symbol", "g", "m", "x"), "symbol").toPandas()
    assert pdf[pdf.symbol == "n"].v.item() == 5.0
    pdf = pdf[pdf.symbol != "n"]
    assert pdf.groupby("g").v.mean().abs().max() < 1e-9 and abs((pdf.v * pdf.m).sum()) < 1e-9
    x = np.column_stack([*(pdf.g == k for k in sorted(set(pdf.g))), pdf.m]).astype(float)
    want = pdf.x - x @ np.linalg.lstsq(x, pdf.x, rcond=None)[0]
    assert np.abs(want - pdf.v).max() < 1e-9


FORMULAS = [
    "DELAY($x,2)", "DELTA($x)", "TS_PCT_CHANGE($x,1)", "TS_MEAN($x,3)", "TS_SUM($x,3)", "TS_STD($x,3)", "TS_MEDIAN($x,3)", "TS_QUANTILE($x,3,0.25)", "TS_MIN($x,3)",
    "TS_MAX($x,3)", "TS_SKEW($x,4)", "TS_KURT($x,5)", "TS_POSITION($x,3)", "TS_RANK_PCT($x,3)", "TS_CORR($x,$y,3)", "TS_COV($x,$y,3)", "TS_MAD($x,3)", "EWM_MEAN($x,3)",
    "TS_COUNT($x>$y,3)", "TS_CONSECUTIVE_COUNT($x>$y,3)", "TS_RSQUARE($x,$y,4)", "TS_SLOPE($x,3)", "TS_DECAY_LINEAR($x,3)", "SAFE_DIV($x,$y)", "CLIP($x,-1,1)", "ABS($x)",
    "SIGN($x)", "LOG1P($x)", "SQRT($x)", "WHERE($x>0,$x,-$y)", "CS_RANK($x)", "CS_ZSCORE($x)", "-$x**2+3*$y/2", "FIN_LAG_REPORT($x,1)", "FIN_DELTA_REPORT($x)",
]


def test_causality_and_order(spark):
    """Rows of the future and the order of rows never change a value."""
    import numpy as np

    rng = np.random.default_rng(8)
    rows = []
    for s in "abc":
        for k in range(14):
            x = None if (s, k) == ("b", 6) else float(rng.normal())
            rows.append((s, D0 + dt.timedelta(k), x, float(rng.normal()), dt.date(2023, 3 * (1 + k // 5), 28)))
    kinds = "symbol string, date date, x double, y double, report_period date"

    def run(data):
        p = Panel(spark.createDataFrame(data, kinds).repartition(3))
        cols = {f"c{k}": dsl.compile_formula(p, f) for k, f in enumerate(FORMULAS)}
        return {(r.symbol, r.date): tuple(r)[2:] for r in p.select(**cols).collect()}

    whole, short = run(rows), run([r for r in rows[::-1] if r[1] < D0 + dt.timedelta(9)])
    for key, got in short.items():
        for f, a, b in zip(FORMULAS, got, whole[key]):
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)), (f, key, a, b)


def test_formula_checks():
    assert all(dsl.check(f) == [] for f in FORMULAS) and {f.split("(")[0] for f in FORMULAS if "(" in f} == set(dsl.OPERATORS)
    for bad in ("DELAY($x,-1)", "TS_MEAN($x,2.5)", "TS_MEAN($x)", "x+1", "$x.y", "$x[0]", "lambda: 1", "$x and $y", "1<$x<2", "EVAL($x)", "TS_MEAN($x,3", "TS_MEAN($x,n=3)", "__import__('os')"):
        assert dsl.check(bad), bad
    assert dsl.check("$x+$z", {"x"}) == ["unknown field z"]
    ok = {"name": "f", "formula": "TS_MEAN($x,5)", "inputs": ["x"], "availability": "after_close"}
    assert dsl.check_batch([ok]) == []
    assert dsl.check_batch([]) and dsl.check_batch([ok, ok]) and dsl.check_batch([ok | {"inputs": ["y"]}]) and dsl.check_batch([ok | {"availability": "open"}]) and dsl.check_batch([{"name": "f"}])


def test_comparisons_with_missing_values(spark):
    p = panel(spark, {"a": [1, None]})
    assert values(p, dsl.compile_formula(p, "WHERE($x>0,1,2)")) == [1, 2]
    assert values(p, dsl.compile_formula(p, "WHERE($x!=1,1,2)")) == [2, 1]
    assert values(p, dsl.compile_formula(p, "1/($x-1)")) == [None, None]


def test_dsl_coerces_text_and_knows_reported_fields(spark):
    df = spark.createDataFrame([("a", D0, "1.5"), ("a", D0 + dt.timedelta(1), "n/a")], "symbol string, date date, x string")
    p = Panel(df)
    assert values(p, dsl.compile_formula(p, "$x*2")) == [3.0, None]
    assert dsl.check("FIN_LAG_REPORT($x,1)", {"x", "roe"}, {"roe"}) == ["FIN_LAG_REPORT takes a reported field"]
    assert dsl.check("FIN_LAG_REPORT($roe,1)", {"x", "roe"}, {"roe"}) == []


def test_narrowed_quantiles_are_exact(spark):
    import numpy as np

    from tessera.operators import statistics as st

    rng = np.random.default_rng(3)
    groups = {"spread": rng.standard_normal(5000), "ties": rng.integers(0, 3, 4000).astype(float), "one": np.array([2.5]), "same": np.full(100, 7.0), "two": np.array([1.0, 4.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None)]
    shares = (0.0, 0.01, 0.25, 0.5, 0.95, 1.0)
    for slack in (1e-3, 1e-12):  # brackets that miss their places widen
        got = st.narrowed_quantiles(spark.createDataFrame(rows, "factor string, x double").repartition(5), "x", "factor", shares, slack)
        assert set(got) == set(groups)
        for g, vs in groups.items():
            assert got[g][0] == len(vs)
            np.testing.assert_allclose(got[g][1], np.quantile(vs, shares), rtol=0, atol=1e-12)


def test_the_distribution_profile_holds_no_factor_in_one_task(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tessera import plans

    def no(*_):
        raise AssertionError("the exact percentile keeps all distinct values of a factor in one task")

    monkeypatch.setattr(F, "percentile", no)
    assert plans.queries()["distribution_profile"](spark, "/root/testdata/sf0.001").count() == 3
