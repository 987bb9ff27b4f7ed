import random

import pandas as pd
import pytest
from pyspark.sql import Window as W, functions as F

from paneloom.functions.ordered import _bucketed, order_counts
from paneloom.operators import ranking as rk, scores as sc


def long(spark, values, date="2020-01-01", factor="f", sector=None):
    data = [(date, factor, f"T{i:03d}", v, sector[i] if sector else None) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "date STRING, factor STRING, ticker STRING, value DOUBLE, sector STRING")


def col(df, name):
    return [r[name] for r in df.orderBy("ticker").collect()]


def hot_panel(spark, n=4000, seed=7):
    """One date holds most rows; a third of its values are the same number, some are missing,
    signs and magnitudes vary, and a cluster sits in a very narrow range."""
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        date = "2020-01-01" if i % 10 else f"2020-02-0{1 + i // 10 % 9}"
        k = rnd.random()
        v = (0.05 if k < .33 else None if k < .4 else 0.0 if k < .5 else rnd.gauss(0, 3) if k < .7
             else 1000 + rnd.randrange(50) * 1e-7 if k < .9 else rnd.choice([-1, 1]) * 10 ** rnd.uniform(-9, 9))
        y = None if rnd.random() < .05 else rnd.gauss(0, 1) + (v or 0) * .001
        data.append((date, "f", f"T{i:05d}", v, "AB"[i % 2] if i % 7 else None, y))
    return spark.createDataFrame(data, "date STRING, factor STRING, ticker STRING, value DOUBLE, sector STRING, y DOUBLE")


def test_ranks_of_four(spark):
    assert col(rk.rank_factors(long(spark, [1.0, 2.0, 3.0, 4.0])), "rank") == [.25, .5, .75, 1.0]


def test_sector_neutral(spark):
    d = long(spark, [1.0, 2.0, 10.0, 20.0], sector=["Tech", "Tech", "Fin", "Fin"])
    assert col(rk.rank_factors(d, sector="sector"), "rank") == [.5, 1.0, .5, 1.0]


def test_missing_sector_gets_no_rank(spark):
    d = long(spark, [1.0, 2.0, 3.0], sector=["A", None, "A"])
    assert col(rk.rank_factors(d, sector="sector"), "rank") == [.5, None, 1.0]


def test_winsorise_tails_and_short_groups(spark):
    d = long(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 100.0])
    w = col(rk.winsorize(d, ["date"], "value", "w", .1, .9), "w")
    s = pd.Series([1, 2, 3, 4, 5, 6, 7, 8, 9, 100.0])
    assert w == pytest.approx(s.clip(s.quantile(.1), s.quantile(.9)).tolist())
    assert col(rk.winsorize(long(spark, [1.0, 2.0, 100.0]), ["date"], "value", "w"), "w") == [1.0, 2.0, 100.0]


def test_hot_group_against_pandas(spark):
    d = hot_panel(spark)
    p = d.toPandas()
    g = p.groupby("date")["value"]
    clipped = g.transform(lambda s: s if s.notna().sum() < 5 else s.clip(s.quantile(.01), s.quantile(.99)))
    p["want_w"], p["want"] = clipped, clipped.groupby(p["date"]).rank(pct=True)
    got = rk.rank_factors(d).select("date", "ticker", "w", "rank").toPandas()
    m = p.merge(got, on=["date", "ticker"])
    assert len(m) == len(p) and (m["rank"].isna() == m["want"].isna()).all()
    assert m["rank"].fillna(0).tolist() == pytest.approx(m["want"].fillna(0).tolist(), abs=1e-12)
    assert m["w"].fillna(0).tolist() == pytest.approx(m["want_w"].fillna(0).tolist(), rel=1e-12)


def test_counts_against_one_window(spark, rows):
    d = hot_panel(spark, 3000, 11)
    got = order_counts(d, ["date", "sector"], "value")
    v, whole = F.col("value"), W.partitionBy("date", "sector")
    unknown = F.count(F.lit(1)).over(whole) - F.count(v).over(whole)
    want = (d.withColumn("below", F.when(v.isNotNull(), F.rank().over(whole.orderBy(v)) - 1 - unknown))
            .withColumn("ties", F.when(v.isNotNull(), F.count(v).over(W.partitionBy("date", "sector", "value"))))
            .withColumn("total", F.when(v.isNotNull(), F.count(v).over(whole))))
    cols = ["ticker", "below", "ties", "total"]
    assert rows(got, *cols) == rows(want, *cols)


def test_infinite_and_close_values(spark):
    """Infinities are ranked like any value, and values that differ by little still spread over the buckets."""
    inf = float("inf")
    d = spark.createDataFrame([(1, x) for x in [-inf, 1.0, 2.0, 2.0, inf]], "g int, v double")
    got = {(r["v"]): (r["below"], r["ties"], r["total"]) for r in order_counts(d, ["g"], "v").collect()}
    assert got == {-inf: (0, 1, 5), 1.0: (1, 1, 5), 2.0: (2, 2, 5), inf: (4, 1, 5)}
    n = 20000
    close = spark.range(n).select(F.lit(1).alias("g"), (100 + F.col("id") * 0.05 / n).alias("v"), F.lit(1).alias("n"))
    share = _bucketed(close, ["g"], "v").groupBy("__b").count().agg(F.max("count")).first()[0] / n
    assert share < 0.04
    assert order_counts(close, ["g"], "v").where("below <> round((v - 100) / 0.05 * 20000)").count() == 0


def test_bounds_that_meet_make_one_tie(spark):
    v = [-1.0] * 4 + [0.0] * 991 + [1.0] * 5
    d = spark.createDataFrame([(1, "f", i, x, float(i % 7)) for i, x in enumerate(v)], "date int, factor string, ticker int, value double, y double")
    r = rk.rank_factors(d)
    assert {x["rank"] for x in r.select("rank").distinct().collect()} == {1001 / 2 / 1000}
    two = rk.pct_rank(rk.winsorize(d, ["date", "factor"], "value", "w"), ["date", "factor"], "w", "rank")
    assert {x["rank"] for x in two.select("rank").distinct().collect()} == {1001 / 2 / 1000}
    s = sc.score_factors(r, "y").first()
    assert s["ic"] is None and s["payoff_slope"] is None


def test_coverage_filter(spark):
    d = long(spark, [1.0, None, None, None, 2.0]).unionByName(long(spark, [1.0, 2.0, 3.0, None, 4.0], factor="g"))
    r = rk.rank_factors(d)
    assert {x["factor"]: x["coverage"] for x in rk.factor_coverage(r).collect()} == {"f": .4, "g": .8}
    assert {x[0] for x in rk.keep_covered(r, .5).select("factor").collect()} == {"g"}


def test_plans_read_their_input_a_few_times(spark):
    """One reading each for cuts, counts, the bounds' buckets and the rows; nothing is copied along a chain of operators."""
    from paneloom.operators import inference as inf
    from paneloom.session import cut_lineage
    stored = cut_lineage(hot_panel(spark, 200))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    ranked = cut_lineage(rk.rank_factors(stored))
    for df, scans, exchanges in ((rk.pct_rank(stored, ["date"], "value"), 5, 14), (rk.rank_factors(stored), 10, 32),
                                 (sc.score_factors(ranked, "y"), 5, 16), (inf.bh_fdr(stored, "value", ["date"]), 10, 32)):
        p = plan(df)
        assert p.count("FileScan") <= scans and p.count("Exchange") <= exchanges, (p.count("FileScan"), p.count("Exchange"))


def test_panel_coverage(spark):
    d = spark.createDataFrame([(1, .1, None, "A"), (2, .2, .3, None), (3, None, None, "A"), (4, .4, None, "B")], "ticker INT, f DOUBLE, g DOUBLE, sector STRING")
    assert {r["factor"]: (r["coverage"], r["kept"]) for r in rk.panel_coverage(d, ["f", "g", "absent"]).collect()} == {"f": (.75, True), "g": (.25, False)}
    assert {r["factor"]: r["coverage"] for r in rk.panel_coverage(d, ["f", "g"], "sector").collect()} == {"f": .5, "g": 0.0}
    assert {r["factor"] for r in rk.covered_long(d, ["f", "g"], ["ticker"]).collect()} == {"f"}


def test_counts_hold_when_cuts_come_out_differently_each_time(spark, rows, monkeypatch):
    """A sketch depends on the order in which its parts arrive, so a second reading may find other cuts."""
    plain = F.percentile_approx
    shaken = F.udf(lambda cuts: cuts and sorted(random.SystemRandom().choice(cuts) for _ in cuts), "array<double>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda *a: shaken(plain(*a)))
    values = [float(i * 7919 % 500) for i in range(2000)]
    d = spark.createDataFrame([("f", i, v, -v) for i, v in enumerate(values)], "factor string, ticker int, value double, y double")
    want = pd.Series(values).rank()
    got = {r["ticker"]: r["below"] + (r["ties"] + 1) / 2 for r in order_counts(d, ["factor"], "value").collect()}
    assert got == dict(enumerate(want))
    assert sc.spearman_ic(d, ["factor"], "value", "y").first()["ic"] == pytest.approx(-1, abs=1e-12)
    ranks = [r["rank"] for r in rk.rank_factors(d, ["factor"], lo=0.0, hi=1.0).orderBy("ticker").collect()]
    assert ranks == pytest.approx((want / 2000).tolist(), abs=1e-12)
