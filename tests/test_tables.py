import pytest

from tessera.sources import tables
from tessera.sources.tables import Contract, assemble, replace_table, scan


def test_scan_contract_and_replace(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01", 0.0), ("a", "2024-01-02", 2.0)], "symbol string, date string, pe double")
    c = Contract("bars", ("symbol", "date"), ("pe",), ("pe",), "date")
    path = str(tmp_path / "bars")
    assert replace_table(df, path, c) == 2 and replace_table(df, path, c, 2) == 2
    assert spark.read.parquet(path + ".bak").count() == 2
    got = scan(spark, path, c, ["pe"], start="2024-01-01")
    assert [r.pe for r in got.orderBy("date").collect()] == [None, 2.0]
    plan = scan(spark, path, c, [], start="2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,2024-01-02)" in plan
    with pytest.raises(ValueError):
        replace_table(df.unionByName(df), path, c)
    with pytest.raises(ValueError):
        replace_table(df, path, c, 3)
    assert spark.read.parquet(path).count() == 2
    assert Contract("x", ("nope",)).problems(df) and Contract("x", ("symbol",)).problems(df)


def test_assemble(spark, tmp_path):
    for name in "ab":
        spark.createDataFrame([(1, 2.0), (2, 3.0)], f"k int, {name} double").write.parquet(str(tmp_path / name))
    got = assemble(spark, str(tmp_path), {"a": ["a"], "b": ["b"]}, ("k",))
    assert got.columns == ["k", "a", "b"] and got.count() == 2
    for bad in ("../x", "/etc", "s3://x"):
        with pytest.raises(ValueError):
            assemble(spark, str(tmp_path), {bad: []}, ("k",))


def test_globs_tsv_reports_and_state(spark, tmp_path):
    for ex in ("sh", "sz"):
        df = spark.createDataFrame([(f"{ex}1", 1.0)], "symbol string, close double")
        (df if ex == "sh" else df.withColumn("extra", df.close)).write.parquet(str(tmp_path / f"daily_{ex}.parquet"))
    got = tables.read_many(spark, {ex: f"{tmp_path}/daily_{ex}*.parquet" for ex in ("sh", "sz")})
    assert sorted(map(tuple, got.select("symbol", "exchange", "extra").collect())) == [("sh1", "sh", None), ("sz1", "sz", 1.0)]
    (tmp_path / "all.txt").write_text("SH600000\t1999-11-10\t2099-12-31\nSZ000001\tx\t\n")
    rows = tables.read_tsv(spark, str(tmp_path / "all.txt"), "symbol string, start date, end date").collect()
    assert [r.symbol for r in rows] == ["SH600000", "SZ000001"] and rows[0].start.year == 1999 and rows[1].start is None
    for kind in ("csv", "json"):
        tables.write_report(got.select("symbol", "close"), str(tmp_path / kind), kind)
        read = spark.read.option("header", True).csv(str(tmp_path / kind)) if kind == "csv" else spark.read.json(str(tmp_path / kind))
        assert read.count() == 2 and set(read.columns) == {"symbol", "close"}
    state = tables.CollectorState(spark, str(tmp_path / "state"))
    assert state.load() == {}
    state.save("a", last_id="3")
    state.save("b", last_id="4")
    state.save("a", last_id="5")
    assert {k: v["last_id"] for k, v in state.load().items()} == {"a": "5", "b": "4"}
