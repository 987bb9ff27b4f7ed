import datetime as dt

import pytest
from pyspark.sql import functions as F

from paneloom.operators import features as ft, quality as ql
from paneloom.plans import ingest as ig
from paneloom.sources import readers as rd, store as st

DAY = dt.date(2020, 6, 1)


def prices(spark, *data):
    return spark.createDataFrame([(dt.date.fromisoformat(d), t, p, 1.0, i) for i, (d, t, p) in enumerate(data)],
                                 "date DATE, ticker STRING, adj_close DOUBLE, volume DOUBLE, seq INT")


def test_keep_last_and_counts(spark, rows):
    p = prices(spark, ("2020-01-01", "A", 10.0), ("2020-01-01", "A", 11.0), ("2020-01-02", "A", 12.0))
    assert rows(ql.keep_last(p, ["date", "ticker"], ["seq"]), "adj_close") == [(11.0,), (12.0,)]
    assert tuple(ql.duplicate_count(p, ["date", "ticker"]).first()) == (3, 2, 1)


def test_validate_table(spark, rows):
    p = prices(spark, ("2020-01-01", "A", 10.0), ("2020-01-02", "A", -5.0), ("2020-01-03", "A", None))
    assert rows(ql.validate_table(p, "prices", "seq"), "adj_close") == [(10.0,), (None,)]
    with pytest.raises(ql.InputError, match="lacks required columns"):
        ql.validate_table(p.drop("volume"), "prices", "seq")
    with pytest.raises(ql.InputError, match="empty"):
        ql.require_rows(p.limit(0), "prices")


def test_csv_scan(spark, tmp_path, rows):
    (tmp_path / "p.csv").write_text(" Volume,TICKER,Date ,adj_close,extra\n5,A,2020-01-01,1.5,x\n6,A,not a date,oops,y\n7,A,2020-01-01,2.5,z\n")
    raw = rd.read_table_csv(spark, str(tmp_path / "p.csv"), "date DATE, ticker STRING, adj_close DOUBLE, volume DOUBLE")
    assert raw.columns[:5] == ["volume", "ticker", "date", "adj_close", "extra"]
    assert rows(ql.validate_table(raw, "prices", "input_seq"), "date", "adj_close", "volume") == [(dt.date(2020, 1, 1), 2.5, 7.0)]
    assert ql.bad_date_count(raw).first()["n_bad_dates"] == 1


def test_missing_ratios_and_staleness(spark):
    d = spark.createDataFrame([(None, 1, None), (None, 2, 1), (1, 3, 2), (None, 4, 3)], "a INT, b INT, c INT")
    assert {r["column_name"]: (r["missing_ratio"], r["band"]) for r in ql.missing_ratios(d).collect()} == {
        "a": (.75, "over half"), "b": (0.0, "ok"), "c": (.25, "some")}
    f = spark.createDataFrame([("A", dt.date(2020, 1, 1)), ("A", dt.date(2020, 7, 1)), ("A", dt.date(2020, 10, 1)), ("B", DAY)],
                              "ticker STRING, date DATE")
    assert tuple(ql.reporting_staleness(f).first()) == (2, 137.0, True)
    assert tuple(ql.reporting_staleness(f.limit(1)).first()) == (0, None, False)


def store_tables(spark, price_day, macro_day, tickers=("A", "B", "C", "D"), series=("credit_spread", "rate_10y", "vix", "benchmark_adj_close")):
    p = spark.createDataFrame([(t, price_day, 1.0) for t in tickers], "ticker STRING, date DATE, adj_close DOUBLE")
    m = spark.createDataFrame([(s, macro_day, 1.0) for s in series], "series_name STRING, observation_date DATE, value DOUBLE")
    f = spark.createDataFrame([(t, DAY - dt.timedelta(days=30)) for t in tickers], "ticker STRING, availability_date DATE")
    u = spark.createDataFrame([(t,) for t in "ABCD"], "ticker STRING")
    return p, m, f, u


@pytest.mark.parametrize("kw,failed", [
    (dict(price_day=DAY, macro_day=DAY), set()),
    (dict(price_day=DAY - dt.timedelta(days=30), macro_day=DAY), {"price_staleness"}),
    (dict(price_day=DAY, macro_day=DAY, series=("rate_10y", "vix", "benchmark_adj_close")), {"macro_credit_spread"}),
    (dict(price_day=DAY, macro_day=DAY - dt.timedelta(days=46)), {"macro_credit_spread", "macro_rate_10y", "macro_vix", "macro_benchmark_adj_close"}),
    (dict(price_day=DAY, macro_day=DAY, tickers=("A",)), {"price_coverage", "fundamentals_coverage"}),
    (dict(price_day=DAY, macro_day=DAY, tickers=()), {"price_coverage", "price_staleness", "fundamentals_coverage"})])
def test_gate(spark, kw, failed):
    p, m, f, u = store_tables(spark, **kw)
    checks = ql.gate_checks(p, m, f, u, DAY)
    assert {r["check_name"] for r in checks.where("NOT passed").collect()} == failed
    v = ql.gate_verdict(checks).first()
    assert v["passed"] is (not failed) and set(filter(None, v["failures"].split(","))) == failed


def test_some_stale_is_only_a_warning(spark):
    p, m, f, u = store_tables(spark, DAY, DAY)
    p = p.withColumn("date", F.when(F.col("ticker") == "A", F.date_sub("date", 30)).otherwise(F.col("date")))
    v = ql.gate_verdict(ql.gate_checks(p, m, f, u, DAY)).first()
    assert v["passed"] and v["warnings"] == "price_staleness"


def test_series_files(spark, tmp_path, rows):
    (tmp_path / "DGS10.csv").write_text("observation_date,DGS10\n2020-01-01,1.5\n2020-02-01,1.6\n2020-03-01,.\n")
    (tmp_path / "DGS2.csv").write_text("DATE,DGS2\n2020-01-15,0.5\n2020-01-20,0.7\n")
    d = rd.read_series_dir(spark, str(tmp_path), {"DGS10": "rate_10y", "DGS2": "rate_2y"})
    assert rows(d.where("series_name = 'rate_10y'"), "value") == [(1.5,), (1.6,), (None,)]
    wide = ig.macro_table(d, ["rate_10y", "rate_2y"])
    assert rows(wide) == [(dt.date(2020, 1, 31), 1.5, .7), (dt.date(2020, 2, 29), 1.6, None)]


def test_index_becomes_yearly_change(spark):
    s = spark.createDataFrame([("cpi_index", dt.date(2019 + i // 12, 1 + i % 12, 15), 100.0 + i) for i in range(13)],
                              "series_name STRING, date DATE, value DOUBLE")
    got = {str(r["date"]): r["cpi_yoy"] for r in ig.macro_table(s, ["cpi_index"]).collect()}
    assert got["2020-01-31"] == pytest.approx(12.0)


def test_wide_block(spark, rows):
    b = spark.createDataFrame([("2020-01-01", 10.0, 1.0), ("2020-01-02", None, 2.0), ("2020-01-03", 12.0, 3.0)],
                              "date STRING, `A|Close` DOUBLE, `A|Volume` DOUBLE")
    assert rows(rd.wide_block_to_prices(b, ["A", "GONE"]), "ticker", "adj_close") == [("A", 10.0), ("A", 12.0)]
    assert rd.wide_block_to_prices(b, ["GONE"]).count() == 0


def test_vendor_records(spark, tmp_path, rows):
    (tmp_path / "m.json").write_text('{"symbol":"A","date":"2020-03-31","roe":0.1,"revenuePerShare":5.0}\n{"symbol":"A","date":"2020-06-30","peRatio":12}\n')
    from paneloom.vocab import METRIC_FIELDS
    d = rd.read_records(spark, str(tmp_path / "m.json"), METRIC_FIELDS).withColumnRenamed("symbol", "ticker")
    assert rows(d, "date", "roe", "pe", "fcf_yield") == [("2020-03-31", .1, None, None), ("2020-06-30", None, 12.0, None)]
    ratios = spark.createDataFrame([("A", "2020-03-31", 1.0, 0), ("A", "2020-03-31", 2.0, 1)], "ticker STRING, date STRING, gross_margin DOUBLE, seq INT")
    f = ig.fundamentals_table(d, ratios, "seq")
    assert rows(f, "date", "gross_margin") == [("2020-03-31", 2.0), ("2020-06-30", None)] and "revenue_per_share" not in f.columns


def test_universe_file(spark, tmp_path, rows):
    (tmp_path / "u.txt").write_text("# head\nabc\n\n  Msft \n#x\n")
    assert rows(rd.read_universe(spark, str(tmp_path / "u.txt"))) == [("ABC",), ("MSFT",)]


def test_macro_shapes(spark, rows):
    m = spark.createDataFrame([(DAY, 1.0, None), (dt.date(2020, 7, 1), 2.0, 3.0)], "date DATE, a DOUBLE, b DOUBLE")
    long = rd.wide_to_long(m)
    assert long.count() == 3
    s = st.macro_rows(m, "p1", "2020-01-01 00:00:00").unionByName(st.macro_rows(m.withColumn("a", F.lit(9.0)), "p2", "2020-02-01 00:00:00"))
    assert rows(rd.long_to_wide(s, ["a", "b"]), "a", "b") == [(9.0, 3.0), (9.0, None)]


def test_ingest_upserts_and_logs(spark, tmp_path, rows):
    path = str(tmp_path / "prices")
    first = prices(spark, ("2020-01-01", "AAA", 10.0), ("2020-02-03", "AAA", 11.0)).drop("seq")
    log = ig.ingest_prices(spark, path, first, "v1", "2020-03-01 00:00:00").first()
    assert (log["status"], log["rows_ingested"]) == ("succeeded", 2)
    again = prices(spark, ("2020-01-01", "AAA", 99.0), ("2020-01-02", "BBB", 5.0)).drop("seq")
    ig.ingest_prices(spark, path, again, "v2", "2020-03-02 00:00:00")
    got = st.read_store(spark, path)
    assert rows(got, "date", "ticker", "adj_close", "provider") == [
        (dt.date(2020, 1, 1), "AAA", 99.0, "v2"), (dt.date(2020, 1, 2), "BBB", 5.0, "v2"), (dt.date(2020, 2, 3), "AAA", 11.0, "v1")]
    assert {len(r[0]) for r in got.select("raw_payload_hash").collect()} == {64}
    bad = again.withColumn("date", F.raise_error(F.lit("boom")).cast("date"))
    log = ig.ingest_prices(spark, path, bad, "v3").first()
    assert log["status"] == "failed" and "boom" in log["error_message"] and st.read_store(spark, path).count() == 3


def test_ingest_macro_and_fundamentals(spark, tmp_path, rows):
    m = spark.createDataFrame([(DAY, 1.0, None)], "date DATE, vix DOUBLE, gold DOUBLE")
    assert ig.ingest_macro(spark, str(tmp_path / "m"), m, "p").first()["rows_ingested"] == 1
    f = spark.createDataFrame([("A", dt.date(2020, 1, 31), .1)], "ticker STRING, date DATE, roe DOUBLE")
    ig.ingest_fundamentals(spark, str(tmp_path / "f"), f, "p")
    assert rows(st.read_store(spark, str(tmp_path / "f")), "availability_date", "roe", "pe", "sector") == [(dt.date(2020, 3, 31), .1, None, None)]


def test_fingerprint_ignores_order_only(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i INT, s STRING")
    h = lambda d: st.fingerprint(d).first()["payload_hash"]
    assert h(a) == h(a.orderBy(F.desc("i"))) != h(a.where("i = 1")) and h(a.limit(0))


def test_result_sinks_and_runs(spark, tmp_path):
    t = {"factor_scores": spark.createDataFrame([(DAY, "f", .1)], "date DATE, factor STRING, ic DOUBLE")}
    st.write_results(t, str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out/factor_scores")).count() == 1
    for run in ("r1", "r2"):
        st.persist_run(t, run, str(tmp_path / "runs"))
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "runs/factor_scores")).select("run_id").collect()} == {"r1", "r2"}


def test_merge_keeps_columns_outside_the_update(spark, rows):
    old = spark.createDataFrame([("a", 1, 1)], "k STRING, v INT, w INT")
    new = spark.createDataFrame([("a", 5, 5, 1), ("a", 6, 6, 2), ("b", 7, 7, 1)], "k STRING, v INT, w INT, o INT")
    assert rows(st.merge_latest(old, new, ["k"], ["v"], ["o"])) == [("a", 6, 1), ("b", 7, 7)]


def test_last_row_of_a_delivery_wins(spark, tmp_path, rows):
    path = str(tmp_path / "prices")
    many = prices(spark, *[("2020-01-01", "AAA", float(p)) for p in range(10, 15)]).drop("seq")
    for _ in range(2):  # into a new store, then over an old one
        assert ig.ingest_prices(spark, path, many.coalesce(1), "v", "2020-03-01 00:00:00").first()["status"] == "succeeded"
        assert rows(st.read_store(spark, path), "ticker", "adj_close") == [("AAA", 14.0)]
    told = many.withColumn("input_seq", -F.col("adj_close").cast("long"))
    ig.ingest_prices(spark, path, told, "v", "2020-03-01 00:00:00")
    assert rows(st.read_store(spark, path), "ticker", "adj_close") == [("AAA", 10.0)]
    assert "input_seq" not in st.read_store(spark, path).columns
    assert [p.name for p in tmp_path.iterdir()] == ["prices"]
    st.vacuum(spark, path, keep=1)
    assert len(list((tmp_path / "prices").glob("data/*/month=*/*.parquet"))) == 1
    bad = many.withColumn("volume", F.raise_error(F.lit("boom")).cast("double"))
    assert ig.ingest_prices(spark, path, bad, "v").first()["status"] == "failed"


def test_upsert_is_one_commit(spark, tmp_path, rows, monkeypatch):
    """A delivery whose commit fails leaves the rows that readers see; old generations go with vacuum, rows do not."""
    path = str(tmp_path / "prices")
    ig.ingest_prices(spark, path, prices(spark, ("2020-01-01", "A", 1.0), ("2020-02-01", "A", 2.0)).drop("seq"), "v")
    fails = lambda *a: (_ for _ in ()).throw(OSError("disk"))
    with monkeypatch.context() as m:
        m.setattr(st, "_commit", fails)
        log = ig.ingest_prices(spark, path, prices(spark, ("2020-01-01", "A", 9.0)).drop("seq"), "v").first()
    assert log["status"] == "failed" and rows(st.read_store(spark, path), "adj_close") == [(1.0,), (2.0,)]
    for v in (3.0, 4.0, 5.0):
        ig.ingest_prices(spark, path, prices(spark, ("2020-01-01", "A", v), ("2020-01-02", "A", v)).drop("seq"), "v")
    data = tmp_path / "prices" / "data"
    before = len(list(data.iterdir()))
    st.vacuum(spark, path, keep=1)
    assert before == 5 and len(list(data.iterdir())) == 2
    assert rows(st.read_store(spark, path), "adj_close") == [(2.0,), (5.0,), (5.0,)]
    assert rows(st.read_store(spark, path, ["2020-02"]), "adj_close") == [(2.0,)]


def test_large_month_is_shared_by_tasks(spark, tmp_path):
    """No task writes a whole month."""
    path = str(tmp_path / "big")
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        d = spark.range(300000).select(F.sha2(F.col("id").cast("string"), 256).alias("ticker"), F.lit(DAY).alias("date"), F.rand(1).alias("adj_close"), F.lit(1.0).alias("volume"))
        assert ig.ingest_prices(spark, path, d, "v").first()["status"] == "succeeded"
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(list((tmp_path / "big" / "data").glob("*/month=2020-06/*.parquet"))) > 3 and st.read_store(spark, path).count() == 300000


def test_failed_run_leaves_no_trace(spark, tmp_path):
    out, t = str(tmp_path / "runs"), spark.createDataFrame([(1, 2.0)], "k INT, v DOUBLE")
    row = st.run_row(spark, "r", spark.createDataFrame([(DAY,)], "as_of_date DATE"), {})
    st.persist_run({"a": t, "b": t, "c": t}, "r1", out, row)
    bad = t.withColumn("v", F.raise_error(F.lit("boom")).cast("double"))
    with pytest.raises(Exception, match="boom"):
        st.persist_run({"a": t, "b": t, "c": bad}, "r2", out, row)
    assert not list((tmp_path / "runs").glob("*/run_id=r2"))
    st.persist_run({"a": t}, "r3", out)  # never committed
    for name in "abc":
        assert [r["run_id"] for r in st.read_runs(spark, out, name).collect()] == ["r1"]


def test_file_order_over_packed_files(spark, tmp_path, rows):
    """Spark reads the large file first; the row of the last file by name still wins."""
    line = "A,2020-01-01,%s,1\n"
    (tmp_path / "b_last.csv").write_text("ticker,date,adj_close,volume\n" + line % 7.5)
    (tmp_path / "a_first.csv").write_text("ticker,date,adj_close,volume\n" + "".join(line % i for i in range(2000)))
    raw = rd.read_table_csv(spark, str(tmp_path), "date DATE, ticker STRING, adj_close DOUBLE, volume DOUBLE")
    assert rows(ql.validate_table(raw, "prices", "input_seq"), "adj_close") == [(7.5,)]
    (tmp_path / "b_last.csv").unlink()
    assert rows(ql.validate_table(raw.sparkSession.read.option("header", True).csv(str(tmp_path)).transform(rd.in_file_order), "prices", "input_seq"), "adj_close") == [("1999",)]


def test_checked_load(spark, rows, tmp_path):
    p = prices(spark, ("2020-01-01", "A", 10.0), ("2020-01-01", "A", 11.0), ("2020-01-02", "A", -1.0), ("2020-01-03", "B", None))
    p = p.unionByName(p.limit(1).withColumn("date", F.lit(None).cast("date")))
    table, audit, issues = ql.load_checked(p, "prices", "seq")
    assert rows(table, "ticker", "adj_close") == [("A", 11.0), ("B", None)]
    a = audit.first()
    assert tuple(a)[:5] == ("prices", 2, 2, dt.date(2020, 1, 1), dt.date(2020, 1, 3))
    assert a["payload_hash"] == st.fingerprint(table.drop("seq")).first()["payload_hash"]
    assert {(r["severity"], r["issue"], r["observed"]) for r in issues.collect()} == {
        ("warning", "bad dates", 1.0), ("warning", "repeated keys", 1.0), ("warning", "prices not above zero", 1.0), ("note", "missing date", .2), ("note", "missing adj_close", .2)}
    with pytest.raises(ql.InputError, match="empty"):
        ql.load_checked(p.limit(0), "prices", "seq")
    with pytest.raises(ql.InputError, match="lacks"):
        ql.load_checked(p.drop("volume"), "prices")
    macro = spark.createDataFrame([(DAY, 1.0), (DAY, 2.0)], "date DATE, vix DOUBLE")
    assert ig.ingest_macro(spark, str(tmp_path / "m"), macro.limit(0), "p").first()["status"] == "succeeded"
    assert rows(ql.load_checked(macro, "macro")[0], "vix") == [(2.0,)]


def test_ingest_writes_its_rows_twice_at_most(spark, tmp_path, monkeypatch):
    """The delivery as it landed, and the store: nothing in between."""
    from pyspark.sql import DataFrameWriter
    from paneloom.plans import ingest as ig
    from paneloom.sources import store as st
    written = []
    real = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: written.append(path) or real(self, path, *a, **k))
    path = str(tmp_path / "prices")
    for value in (1.0, 2.0):
        rows = [("A", f"2020-0{m}-03", value * s, 5.0, s) for m in (1, 2) for s in (2, 1)]
        df = spark.createDataFrame(rows, "ticker string, date string, adj_close double, volume double, input_seq int").withColumn("date", F.to_date("date"))
        log = ig.ingest_prices(spark, path, df, "p", "2020-03-01 00:00:00").first()
        assert (log["rows_ingested"], log["status"]) == (4, "succeeded")
        assert [r["adj_close"] for r in st.read_store(spark, path).collect()] == [2 * value] * 2
    assert len(written) == 4
