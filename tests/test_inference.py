import datetime as dt
import random

import numpy as np
import pytest

from paneloom import vocab
from paneloom.operators import inference as inf


def xy(spark, xs, ys):
    return spark.createDataFrame([("g", x, y) for x, y in zip(xs, ys)], "k STRING, x DOUBLE, y DOUBLE")


def test_ols_drops_missing_and_needs_dof(spark):
    xs, ys = [1.0, 2.0, None, 4.0, 5.0, 6.0], [2.0, 4.0, 5.0, 8.0, 10.0, 12.5]
    r = inf.ols(xy(spark, xs, ys), ["k"], "x", "y").first()
    ok = [(a, b) for a, b in zip(xs, ys) if a is not None]
    X = np.column_stack([np.ones(5), [a for a, _ in ok]])
    y = np.array([b for _, b in ok])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    s2 = ((y - X @ beta) ** 2).sum() / 3
    se = np.sqrt(np.diag(s2 * np.linalg.inv(X.T @ X)))
    assert r["n"] == 5 and (r["alpha"], r["beta"]) == pytest.approx(tuple(beta))
    assert (r["alpha_se"], r["se"]) == pytest.approx(tuple(se))
    assert inf.ols(xy(spark, xs[:2] + [3.0], ys[:3]), ["k"], "x", "y").first()["beta"] is None
    assert inf.ols(xy(spark, [1.0] * 8, [float(i) for i in range(8)]), ["k"], "x", "y").first()["beta"] is None
    inf_row = inf.ols(xy(spark, xs + [float("inf")], ys + [1.0]), ["k"], "x", "y").first()
    assert inf_row["n"] == 5


def test_bh_by_hand(spark):
    p = [.02, .001, .9, .01, None, .5, .04]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i INT, p_value DOUBLE")
    got = {r["p_value"]: r["q_value"] for r in inf.bh_fdr(df).collect()}
    want = {.001: .006, .01: .03, .02: .04, .04: .06, .5: .6, .9: .9}
    assert got.pop(None) is None and got == pytest.approx(want)


def test_bh_random_families_with_ties(spark):
    rnd = random.Random(4)
    data = [("HOT" if rnd.random() < .7 else f"f{rnd.randrange(3)}", round(rnd.random() ** 3, 2) if rnd.random() > .1 else None, i)
            for i in range(1500)]
    got = {r["i"]: r["q_value"] for r in inf.bh_fdr(spark.createDataFrame(data, "fam STRING, p_value DOUBLE, i INT"),
                                                     family=["fam"]).collect()}
    for fam in {d[0] for d in data}:
        ps = sorted(((p, i) for f, p, i in data if f == fam and p is not None))
        n, run = len(ps), 1.0
        for k in range(n - 1, -1, -1):
            run = min(run, ps[k][0] * n / (k + 1))
            assert got[ps[k][1]] == pytest.approx(run, abs=1e-12)
    assert all(got[i] is None for f, p, i in data if p is None)


def quarters(n):
    return [dt.date(2000 + i // 4, 3 * (i % 4) + 1, 1) for i in range(n)]


def interaction(spark, n):
    rnd = random.Random(9)
    ds = quarters(n)
    m = [rnd.gauss(0, 1) for _ in ds]
    s = spark.createDataFrame([(d, "f", .5 * x + rnd.gauss(0, .05)) for d, x in zip(ds, m)], "date DATE, factor STRING, payoff_slope DOUBLE")
    st = spark.createDataFrame([(d, x, None) for d, x in zip(ds, m)], "date DATE, credit_spread_z DOUBLE, vix_z DOUBLE")
    return inf.interaction_tests(s, st).collect()


def test_planted_slope_found_untestable_pair_left_out(spark):
    (r,) = interaction(spark, 30)
    assert r["interaction_beta"] == pytest.approx(.5, abs=.05) and r["significant_fdr"] and r["n_tests_in_family"] == 1
    assert interaction(spark, 5) == []


def persistence(spark, series):
    data = [(d, f, v) for f, vs in series.items() for d, v in zip(quarters(len(vs)), vs)]
    df = spark.createDataFrame(data, "date DATE, factor STRING, ic DOUBLE")
    return {(r["factor"], r["lag"]): r for r in inf.payoff_persistence(df).collect()}


def test_persistence_readings(spark):
    def ar(phi, seed):
        rnd, x, out = random.Random(seed), 0.0, []
        for _ in range(60):
            x = phi * x + rnd.gauss(0, .1)
            out.append(x)
        return out
    got = persistence(spark, {"mom": ar(.85, 1), "rev": ar(-.85, 2), "short": [.1, .2, .3]})
    assert got["mom", 1]["classification"] == vocab.MOMENTUM
    assert got["rev", 1]["classification"] == vocab.REVERTING
    assert got["short", 1]["classification"] == vocab.NO_HISTORY and got["short", 1]["significant_fdr"] is False
    assert {r["n_tests_in_family"] for r in got.values()} == {6} and got["short", 4]["n"] == 0
