import random

import pandas as pd
import pytest

from paneloom.operators import rolling as rl, scores as sc


def xy(spark, xs, ys, key="d"):
    return spark.createDataFrame([(key, x, y) for x, y in zip(xs, ys)], "k STRING, x DOUBLE, y DOUBLE")


def test_perfect_ic_and_small_sample(spark):
    v = [float(i) for i in range(20)]
    r = sc.spearman_ic(xy(spark, v, v), ["k"], "x", "y").first()
    assert (r["ic"], r["n"]) == (pytest.approx(1.0), 20)
    r = sc.spearman_ic(xy(spark, v[:5], v[:5]), ["k"], "x", "y").first()
    assert (r["ic"], r["n"]) == (None, 5)


def test_ic_ranks_only_pairs_and_constant_side(spark):
    rnd = random.Random(3)
    xs = [None if rnd.random() < .2 else float(rnd.randrange(8)) for _ in range(60)]
    ys = [None if rnd.random() < .2 else rnd.gauss(0, 1) for _ in range(60)]
    p = pd.DataFrame({"x": xs, "y": ys}).dropna()
    want = p["x"].rank().corr(p["y"].rank())
    r = sc.spearman_ic(xy(spark, xs, ys), ["k"], "x", "y").first()
    assert r["ic"] == pytest.approx(want, abs=1e-12) and r["n"] == len(p)
    assert sc.spearman_ic(xy(spark, [1.0] * 20, [float(i) for i in range(20)]), ["k"], "x", "y").first()["ic"] is None


def test_spread_by_hand(spark):
    v = [float(i) for i in range(100)]
    assert sc.quantile_spread(xy(spark, v, v), ["k"], "x", "y").first()["spread"] == pytest.approx(79.5)
    assert sc.quantile_spread(xy(spark, v[:14], v[:14]), ["k"], "x", "y").first()["spread"] is None


def test_slope_scales_over_all_ranks(spark):
    ranks = [(i + 1) / 20 for i in range(20)]
    ys = [2 * r + 1 if i >= 10 else None for i, r in enumerate(ranks)]
    sd = pd.Series(ranks).std()
    assert sc.payoff_slope(xy(spark, ranks, ys), ["k"], "x", "y").first()["payoff_slope"] == pytest.approx(2 * sd)
    few = [y if i >= 16 else None for i, y in enumerate(ys)]
    assert sc.payoff_slope(xy(spark, ranks, few), ["k"], "x", "y").first()["payoff_slope"] is None


def test_every_date_factor_has_a_row(spark):
    d = spark.createDataFrame([("2020-01-01", "f", "A", None, .1)], "date STRING, factor STRING, ticker STRING, rank DOUBLE, y DOUBLE")
    r = sc.score_factors(d, "y").first()
    assert (r["ic"], r["spread"], r["payoff_slope"], r["n_stocks"]) == (None, None, None, 0)


def test_rolling_against_pandas(spark):
    rnd = random.Random(5)
    data = [(f"2020-{1 + i // 28:02d}-{1 + i % 28:02d}", "f", None if rnd.random() < .3 else rnd.gauss(0, 1), rnd.gauss(0, 1))
            for i in range(60)]
    df = spark.createDataFrame(data, "date STRING, factor STRING, ic DOUBLE, spread DOUBLE")
    got = rl.add_rolling_stats(df, 8).orderBy("date").toPandas()
    s = pd.Series([x[2] for x in data], dtype=float)
    roll = s.rolling(8, min_periods=4)
    want = {"rolling_ic": roll.mean(), "rolling_ic_se": roll.std() / roll.count() ** .5,
            "hit_rate": (s > 0).rolling(8, min_periods=4).mean(), "strengthening_4p": roll.mean().diff(4)}
    for c, w in want.items():
        pd.testing.assert_series_equal(got[c].astype(float), w, check_names=False, rtol=1e-10)


def test_constant_ic_has_no_t(spark):
    df = spark.createDataFrame([(f"2020-01-{i:02d}", "f", .1, .1) for i in range(1, 10)], "date STRING, factor STRING, ic DOUBLE, spread DOUBLE")
    last = rl.add_rolling_stats(df, 8).orderBy("date").collect()[-1]
    assert last["rolling_ic_se"] == pytest.approx(0, abs=1e-15) and (last["rolling_ic_t"] is None or last["rolling_ic_se"] > 0)
