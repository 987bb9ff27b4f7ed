import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from paneloom.operators import calendar as cal, features as ft


def bdays(n, start="2018-01-01"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


@pytest.fixture(scope="module")
def market(spark):
    """Three tickers with gaps, a late start and an early end, and a monthly benchmark."""
    rnd, days, data = random.Random(2), bdays(420), []
    for t, lo, hi in (("A", 0, 420), ("B", 100, 420), ("C", 0, 300)):
        p = 100.0
        for i in range(lo, hi):
            p *= 1 + rnd.gauss(0, .02)
            if t != "B" or rnd.random() > .3:
                data.append((days[i], t, p, 1.0))
    macro = [(d.date(), 1000 + 10 * rnd.gauss(0, 1) + i, 50 + rnd.gauss(0, 3)) for i, d in
             enumerate(pd.date_range("2017-12-31", periods=22, freq="ME"))]
    return (spark.createDataFrame(data, "date DATE, ticker STRING, adj_close DOUBLE, volume DOUBLE"),
            spark.createDataFrame(macro, "date DATE, benchmark_adj_close DOUBLE, wti_oil DOUBLE"))


def matrix(prices):
    p = prices.toPandas()
    p["date"] = pd.to_datetime(p["date"])
    return p.pivot(index="date", columns="ticker", values="adj_close").sort_index()


def test_price_features_against_pandas(spark, market):
    prices, macro = market
    px = matrix(prices)
    days = cal.trading_calendar(prices)
    rd = cal.rebalance_dates(days, "M", 252, 63)
    bench = ft.benchmark_on_calendar(days, macro)
    got = ft.price_features(prices, days, rd, bench).toPandas()
    m = macro.toPandas()
    b = pd.Series(m["benchmark_adj_close"].values, index=pd.to_datetime(m["date"])).reindex(px.index, method="ffill")
    ret, br = px.ffill().pct_change(), b.pct_change()
    ret = ret.where(px.ffill().shift(1).notna())
    want = []
    last = pd.Series(px.index, index=px.index).groupby(px.index.to_period("M")).max()
    for d in last:
        i = px.index.get_loc(d)
        if i < 252 or i + 63 >= len(px):
            continue
        for t in px.columns:
            r, bw = ret[t].iloc[i - 252:i], br.iloc[i - 252:i]
            want.append((d.date(), t, px[t].iloc[i] / px[t].iloc[i - 126] - 1, -r.iloc[-126:].std() * np.sqrt(252),
                         -r.cov(bw) / bw.var(), px[t].iloc[i + 63] / px[t].iloc[i] - 1 - (b.iloc[i + 63] / b.iloc[i] - 1)))
    want = pd.DataFrame(want, columns=["date", "ticker", "momentum_6m", "low_volatility", "low_beta", "forward_excess_return"])
    j = want.merge(got, on=["date", "ticker"], suffixes=("", "_g"))
    assert len(j) == len(want) == len(got) and len(want) >= 12
    for c in want.columns[2:]:
        np.testing.assert_allclose(j[c + "_g"].astype(float), j[c], rtol=1e-9, atol=1e-12)


def test_sensitivity_against_pandas(spark, market):
    prices, macro = market
    px = matrix(prices)
    days = cal.trading_calendar(prices)
    rd = cal.rebalance_dates(days, "M", 252, 63)
    got = {(r["date"], r["ticker"]): r["commodity_sensitivity"]
           for r in ft.commodity_sensitivity(prices, days, rd, macro).collect()}
    mret = px.resample("ME").last().ffill().pct_change()
    m = macro.toPandas()
    w = pd.Series(m["wti_oil"].values, index=pd.to_datetime(m["date"])).pct_change()
    for d in [r["date"] for r in rd.collect()]:
        win = mret.loc[:pd.Timestamp(d)].tail(12)
        for t in px.columns:
            want = win[t].corr(w.reindex(win.index))
            have = got[(d, t)]
            assert (pd.isna(want) and have is None) or have == pytest.approx(want, abs=1e-10)


def test_padded_grid(spark, rows):
    d = spark.createDataFrame([("A", 1, 1.0, 0, 5), ("A", 3, 4.0, 0, 5), ("A", 2, None, 0, 5)], "e STRING, i INT, v DOUBLE, __lo INT, __hi INT")
    assert rows(cal.padded_grid(d, "e", "i", "v"), "i", "v", "filled", "ret") == [
        (0, None, None, None), (1, 1.0, 1.0, None), (2, None, 1.0, 0.0), (3, 4.0, 4.0, 3.0), (4, None, 4.0, 0.0), (5, None, 4.0, 0.0)]


def test_rebalance_needs_history_and_future(spark):
    days = cal.trading_calendar(spark.createDataFrame([(d,) for d in bdays(400)], "date DATE"))
    got = [r["day_idx"] for r in cal.rebalance_dates(days, "Q", 252, 63).orderBy("date").collect()]
    assert got and min(got) >= 252 and max(got) + 63 < 400


def test_derived_factors(spark):
    f = spark.createDataFrame([(1.0, 10.0, 8.0), (1.0, -5.0, 0.0)], "debt_to_equity DOUBLE, pe DOUBLE, ev_ebitda DOUBLE")
    got = [tuple(r) for r in ft.derive_factors(f).select("debt_to_equity_inv", "earnings_yield", "ev_ebitda_inv").collect()]
    assert got == [(-1.0, .1, .125), (-1.0, None, None)]
    assert "shares_dilution_inv" not in ft.derive_factors(f).columns


def test_macro_states_never_look_ahead(spark, rows):
    data = [(d.date(), float(v), None if i == 9 else float(i % 5)) for i, (d, v) in
            enumerate(zip(pd.date_range("2018-01-31", periods=20, freq="ME"), np.linspace(1, 5, 20)))]
    make = lambda k: ft.macro_states(spark.createDataFrame(data[:k], "date DATE, credit_spread DOUBLE, vix DOUBLE"))
    assert rows(make(20).where(f"date <= DATE '{data[14][0]}'")) == rows(make(15))
    s = pd.Series([x[1] for x in data])
    want = (s - s.expanding(8).mean()) / s.expanding(8).std()
    got = [r["credit_spread_z"] for r in make(20).orderBy("date").collect()]
    assert got[:7] == [None] * 7 and got[7:] == pytest.approx(want[7:].tolist())
    assert set(make(20).columns) == {"date", "credit_spread_z", "vix_z"}


def test_yearly_growth(spark):
    f = spark.createDataFrame([("A", dt.date(2020, 3 * i + 1, 1) if i < 4 else dt.date(2021, 1, 1), v)
                               for i, v in enumerate([10.0, 10.5, 11.0, 11.5, 12.0])], "ticker STRING, date DATE, rps DOUBLE")
    got = [r["revenue_growth"] for r in ft.yoy_growth(f, "rps").orderBy("date").collect()]
    assert got[:4] == [None] * 4 and got[4] == pytest.approx(.2)


def test_pad_filled_change(spark):
    d = spark.createDataFrame([(1, 1.0), (2, None), (3, 4.0)], "date INT, v DOUBLE")
    assert [r["chg"] for r in ft.pad_change(d, "v").orderBy("date").collect()] == [None, 0.0, 3.0]


def test_grid_with_repeats_and_empty_entities(spark, rows):
    d = spark.createDataFrame([("A", 0, 10.0, 1, 0, 3), ("A", 2, 11.0, 1, 0, 3), ("A", 2, 12.0, 2, 0, 3), ("B", 1, None, 1, 0, 3), ("B", 2, None, 1, 0, 3)],
                              "e STRING, i INT, v DOUBLE, s INT, __lo INT, __hi INT")
    want = [("A", 0, 10.0, None), ("A", 1, None, 0.0), ("A", 2, 12.0, .2), ("A", 3, None, 0.0), *[("B", i, None, None) for i in range(4)]]
    assert rows(cal.padded_grid(d, "e", "i", "v", seq="s"), "e", "i", "v", "ret") == want
    assert rows(cal.padded_grid(d, "e", "i", "v"), "e", "i", "v", "ret") == want
