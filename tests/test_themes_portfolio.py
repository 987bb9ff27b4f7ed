import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from paneloom import vocab
from paneloom.operators import portfolio as pf, themes as th

D = [dt.date(2020, m, 28) for m in (3, 6, 9, 12)]


def rolled(spark, *data):
    return spark.createDataFrame(list(data), "date DATE, factor STRING, rolling_ic DOUBLE, rolling_spread DOUBLE, strengthening_4p DOUBLE")


def pscores(spark, *data):
    return spark.createDataFrame(list(data), "date DATE, priority STRING, priority_score DOUBLE")


def test_mean_of_scored_members(spark):
    ps = th.score_themes(rolled(spark, (D[0], "fcf_yield", .1, .01, None), (D[0], "free_cash_flow_margin", .3, None, None),
                                (D[0], "eps_revision", None, .5, .5)), th.theme_table(spark))
    got = {r["priority"]: r for r in ps.collect()}
    c = got["Cash generation"]
    assert (c["priority_score"], c["n_members_scored"], c["n_members_defined"]) == (pytest.approx(.2), 2, 3)
    assert c["priority_spread"] == pytest.approx(.01) and c["strengthening"] is None
    assert "Growth scarcity" not in got


def test_single_theme_has_zero_standing(spark):
    ps = th.score_themes(rolled(spark, (D[0], "momentum_6m", .1, .01, None)), th.theme_table(spark))
    assert [r["priority_z"] for r in ps.collect()] == [0.0]


def test_overlap(spark):
    tt = th.theme_table(spark)
    jac = lambda present: {(r["a"], r["b"]): r["jaccard"] for r in th.theme_overlap(
        tt, spark.createDataFrame([(p,) for p in present], "factor STRING")).collect()}
    one = jac(["fcf_yield"])
    assert one["Cash generation", "Cash generation"] == 1.0 and one["Growth scarcity", "Growth scarcity"] is None
    assert jac(["revenue_growth", "low_beta"])["Growth scarcity", "Risk avoidance"] == 0.0
    assert len(one) == len(vocab.THEMES) ** 2


@pytest.mark.parametrize("k,want", [(4, .75), (1, .9)])
def test_smoothed_weights(spark, k, want):
    data = [(d, "X", .1) for d in D[:3]] + [(D[3], "X", .9)] + [(d, "Y", .1) for d in D]
    w = {(r["date"], r["priority"]): r["weight"] for r in th.theme_weights(pscores(spark, *data), k).collect()}
    assert w[D[3], "X"] == pytest.approx(want)


def test_nothing_positive_means_equal_shares_of_the_day(spark):
    data = [(D[0], "X", -.1), (D[0], "Z", -.2), (D[1], "X", -.1), (D[1], "Y", -.3)]
    w = {(r["date"], r["priority"]): r["weight"] for r in th.theme_weights(pscores(spark, *data), 4).collect()}
    assert w == {(D[0], "X"): .5, (D[0], "Z"): .5, (D[1], "X"): .5, (D[1], "Y"): .5}


def test_window_counts_scored_dates_not_theme_rows(spark):
    data = [(D[0], "X", 1.0), (D[1], "Y", 1.0), (D[2], "Y", 1.0), (D[2], "X", .5)]
    w = {(r["date"], r["priority"]): r["weight"] for r in th.theme_weights(pscores(spark, *data), 2).collect()}
    assert w[D[2], "X"] == pytest.approx(.5 / 1.5) and w[D[1], "X"] == pytest.approx(.5)


def ranked(spark, *data):
    return spark.createDataFrame(list(data), "date DATE, ticker STRING, factor STRING, rank DOUBLE, forward_excess_return DOUBLE")


def test_composite_and_unscored_day(spark):
    tt = th.theme_table(spark, {"T one": ["f"], "T two": ["g"]})
    r = ranked(spark, (D[0], "A", "f", .9, .1), (D[0], "B", "f", .1, .2), (D[0], "C", "f", None, .3), (D[0], "C", "h", .5, .3))
    ps = pscores(spark, (D[0], "T one", .4))
    got = [tuple(x) for x in pf.composite_ranks(r, ps, tt).orderBy("rank").collect()]
    assert got == [("A", .9, .9, None, 1, D[0]), ("B", .1, .1, None, 2, D[0]), ("C", 0.0, None, None, 3, D[0])]
    assert pf.composite_ranks(r, ps, tt, as_of_date="2019-01-01").collect() == []
    assert pf.composite_ranks(r, ps, tt, as_of_date=str(D[0]), n=1).count() == 1


def test_default_day_falls_back_to_last_scored_weights(spark):
    tt = th.theme_table(spark, {"T": ["f"], "U": ["g"]})
    r = ranked(spark, (D[1], "A", "f", .4, None), (D[1], "A", "g", .8, None))
    ps = pscores(spark, (D[0], "T", 1.0), (D[0], "U", 3.0))
    (x,) = pf.composite_ranks(r, ps, tt).collect()
    assert x["as_of_date"] == D[1] and x["composite_score"] == pytest.approx(.25 * .4 + .75 * .8)


def wf_input(spark, dates):
    rets = {"A": [.05, .04, .03, .02], "B": [-.05, -.04, -.03, -.02]}
    data = [(d, t, "f", r, rets[t][i]) for i, d in enumerate(dates) for t, r in (("A", .9), ("B", .1))]
    return ranked(spark, *data), pscores(spark, *[(d, "T", .2) for d in dates])


def test_walk_forward_and_truncation(spark, rows):
    tt = th.theme_table(spark, {"T": ["f"]})
    full = rows(pf.walk_forward(*wf_input(spark, D), tt, n=1))
    assert [(x[2], x[3]) for x in full] == [(.05, True), (.04, True), (.03, True), (.02, True)]
    assert rows(pf.walk_forward(*wf_input(spark, D[:3]), tt, n=1)) == full[:3]


def test_cut_comes_before_missing_outcomes(spark):
    tt = th.theme_table(spark, {"T": ["f"]})
    r = ranked(spark, (D[0], "A", "f", .9, None), (D[0], "B", "f", .8, .1), (D[0], "C", "f", .7, .9))
    (x,) = pf.walk_forward(r, pscores(spark, (D[0], "T", 1.0)), tt, n=2).collect()
    assert (x["n_holdings"], x["portfolio_forward_excess_return"]) == (1, .1)


def test_summary(spark):
    vals = [.01] * 9 + [.50]
    wf = spark.createDataFrame([(dt.date(2010 + i, 1, 1), 5, v, v > 0) for i, v in enumerate(vals)],
                               "date DATE, n_holdings INT, portfolio_forward_excess_return DOUBLE, hit BOOLEAN")
    r = pf.walk_forward_summary(wf).first()
    s = pd.Series(vals)
    capped = s.clip(*np.quantile(s, [.05, .95]))
    assert r["mean_forward_excess_return"] == pytest.approx(.059) and r["hit_rate"] == 1.0
    assert r["mean_forward_excess_return_winsorized"] == pytest.approx(capped.mean()) and capped.mean() < .059
    assert r["se_winsorized"] == pytest.approx(capped.std() / 10 ** .5)
    assert r["warning"].startswith("Only 10 real historical")
    e = pf.walk_forward_summary(wf.limit(0)).first()
    assert e["n_periods"] == 0 and e["mean_forward_excess_return"] is None and e["warning"].startswith("No rebalance")


def test_random_composite_against_pandas(spark):
    rnd = random.Random(8)
    themes = {"T1": ["a", "b"], "T2": ["b", "c"], "T3": ["z"]}
    data = [(d, f"K{i}", f, None if rnd.random() < .3 else rnd.random(), rnd.gauss(0, 1)) for d in D for i in range(12) for f in "abc"]
    ps = [(d, t, rnd.gauss(.1, .2)) for d in D for t in themes if rnd.random() < .8]
    got = {(x["date"], x["ticker"]): x["composite_score"] for x in pf.composite_scores(pf.theme_ranks(
        ranked(spark, *data), th.theme_table(spark, themes), th.weights_per_date(th.theme_weights(pscores(spark, *ps), 2)))).collect()}
    p = pd.DataFrame(ps, columns=["date", "t", "s"])
    x = pd.DataFrame(data, columns=["date", "k", "f", "r", "y"])
    days = sorted(p["date"].unique())
    for i, d in enumerate(days):
        w = p[p["date"].isin(days[max(0, i - 1):i + 1])].groupby("t")["s"].mean().clip(lower=0)
        if w.sum() <= 0:
            w = pd.Series(1.0, index=p[p["date"] == d]["t"])
        w = w / w.sum()
        g = x[x["date"] == d].pivot(index="k", columns="f", values="r").astype(float)
        for k in g.index:
            want = sum(w[t] * np.nan_to_num(g.loc[k, [f for f in themes[t] if f in g]].mean()) for t in w.index if t != "T3")
            assert got[d, k] == pytest.approx(want)


def test_equal_terms_tie_in_any_order(spark):
    """.1 + .2 + .3 and .3 + .2 + .1 differ in the last bit; entities with the same terms tie all the same."""
    terms = [("t1", .1), ("t2", .2), ("t3", .3)]
    rows = [(D[0], "B", t, r, 1.0) for t, r in terms] + [(D[0], "A", t, r, 1.0) for t, r in terms[::-1]] + [(D[0], "C", None, None, None)]
    tr = spark.createDataFrame(rows, "date DATE, ticker STRING, priority STRING, theme_rank DOUBLE, weight DOUBLE").coalesce(1)
    got = {r["ticker"]: (r["rank"], r["composite_score"]) for r in pf.top_n(pf.composite_scores(tr), 3).collect()}
    assert got == {"A": (1, .6), "B": (2, .6), "C": (3, 0.0)}
