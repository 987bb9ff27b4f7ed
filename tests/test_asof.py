import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneloom.operators import asof


def panel(spark, *rows):
    return spark.createDataFrame([(dt.date.fromisoformat(d), t) for d, t in rows], "date DATE, ticker STRING")


def facts(spark, *rows):
    return spark.createDataFrame([(dt.date.fromisoformat(d), t, v, w) for d, t, v, w in rows],
                                 "date DATE, ticker STRING, v DOUBLE, w DOUBLE")


@pytest.mark.parametrize("span", [None, 30])
@pytest.mark.parametrize("day,fs,want,matched", [
    ("2020-04-01", [("2020-01-01", .01), ("2020-03-15", .02), ("2020-03-25", .03)], .01, "2020-01-01"),
    ("2020-06-01", [("2020-01-01", .01), ("2020-03-01", .02), ("2020-05-01", .03)], .02, "2020-03-01"),
    ("2020-02-01", [("2020-01-25", .01)], None, None)])
def test_reporting_lag(spark, span, day, fs, want, matched):
    f = facts(spark, *[(d, "AAA", v, None) for d, v in fs])
    r = asof.fundamentals_asof(panel(spark, (day, "AAA")), f, 60, span_days=span).collect()
    assert len(r) == 1 and r[0]["v"] == want
    assert r[0]["fundamental_date"] == (dt.date.fromisoformat(matched) if matched else None)


def test_whole_row_matches_and_equality_counts(spark):
    f = facts(spark, ("2020-01-01", "A", 1.0, 1.0), ("2020-02-01", "A", None, 2.0))
    r = asof.fundamentals_asof(panel(spark, ("2020-02-01", "A"), ("2020-01-31", "A"), ("2020-02-01", "B")), f, 0)
    got = {(str(x["date"]), x["ticker"]): (x["v"], x["w"]) for x in r.collect()}
    assert got == {("2020-02-01", "A"): (None, 2.0), ("2020-01-31", "A"): (1.0, 1.0), ("2020-02-01", "B"): (None, None)}


def test_equal_right_dates_last_wins(spark):
    f = spark.createDataFrame([(dt.date(2020, 1, 1), "A", 1.0, 0), (dt.date(2020, 1, 1), "A", 2.0, 1)],
                              "date DATE, ticker STRING, v DOUBLE, seq INT")
    assert asof.fundamentals_asof(panel(spark, ("2020-01-05", "A")), f, 0, seq="seq").first()["v"] == 2.0


@pytest.mark.parametrize("span", [None, 7, 90, 4000])
def test_against_merge_asof(spark, span):
    rnd = random.Random(1)
    day = lambda: dt.date(2019, 1, 1) + dt.timedelta(days=rnd.randrange(900))
    key = lambda: "HOT" if rnd.random() < .6 else f"K{rnd.randrange(5)}"
    left = pd.DataFrame({(day(), key()) for _ in range(400)}, columns=["date", "ticker"])
    right = pd.DataFrame({(day(), key()) for _ in range(300)}, columns=["date", "ticker"])
    right["v"] = [None if rnd.random() < .2 else rnd.random() for _ in range(len(right))]
    l2, r2 = left.copy(), right.copy()
    for x in (l2, r2):
        x["date"] = pd.to_datetime(x["date"])
    l2["cut"] = l2["date"] - pd.Timedelta(days=60)
    want = pd.merge_asof(l2.sort_values("cut"), r2.rename(columns={"date": "rd"}).sort_values("rd"),
                         left_on="cut", right_on="rd", by="ticker")
    w = {(x.date.date(), x.ticker): (None if pd.isna(x.v) else x.v) for x in want.itertuples()}
    got = asof.fundamentals_asof(spark.createDataFrame(left, "date DATE, ticker STRING"),
                                 spark.createDataFrame(right.astype(object).where(right.notna(), None), "date DATE, ticker STRING, v DOUBLE"),
                                 60, span_days=span).collect()
    assert {(x["date"], x["ticker"]): x["v"] for x in got} == w and len(got) == len(left)


def test_unkeyed_asof(spark):
    s = spark.createDataFrame([(dt.date(2020, 1, 31), 1.0), (dt.date(2020, 2, 29), None)], "date DATE, x DOUBLE")
    p = panel(spark, ("2020-01-30", "A"), ("2020-02-15", "A"), ("2020-03-01", "A"), ("2020-03-01", "B"))
    got = {(str(r["date"]), r["ticker"]): r["x"] for r in asof.asof_by_date(p, s).collect()}
    assert got == {("2020-01-30", "A"): None, ("2020-02-15", "A"): 1.0, ("2020-03-01", "A"): None, ("2020-03-01", "B"): None}


def test_heavy_key_in_even_spans(spark, rows):
    """One key holds nine rows in ten; its rows are dealt over spans, and no span holds more than a few per cent."""
    rnd = random.Random(8)
    base = dt.date(2000, 1, 1)
    pick = lambda: ("HOT" if rnd.random() < .9 else f"k{rnd.randrange(5)}", base + dt.timedelta(days=int(rnd.random() ** 2 * 2000)))
    left = spark.createDataFrame([(*pick(), i) for i in range(3000)] + [("HOT", None, -1)], "k STRING, d DATE, i INT")
    right = spark.createDataFrame([(*pick(), float(i)) for i in range(1500)], "k STRING, d DATE, v DOUBLE")
    one = asof.asof_join(left, right, ["k"], "d", "d", "m")
    assert rows(asof.asof_join(left, right, ["k"], "d", "d", "m", span_rows=100)) == rows(one)
    both = left.select("k", F.col("d").alias("__t")).unionByName(right.select("k", F.col("d").alias("__t")))
    starts = {r["k"]: r["__starts"] for r in asof.span_starts(both, ["k"], 100).collect()}
    hot = sorted(r["__t"] for r in both.where("k = 'HOT' and __t is not null").collect())
    sizes = [sum(a <= t < b for t in hot) for a, b in zip([dt.date.min, *starts["HOT"]], [*starts["HOT"], dt.date.max])]
    assert sum(sizes) == len(hot) and max(sizes) < .06 * 4500
