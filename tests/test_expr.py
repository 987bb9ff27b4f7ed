import pytest
from pyspark.sql import functions as F

from paneloom.functions import expr as E


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("t,dof,p", [  # tabulated 5 % points
    (12.706205, 1, 0.05), (4.302653, 2, 0.05), (3.182446, 3, 0.05), (2.776445, 4, 0.05),
    (2.228139, 10, 0.05), (2.200985, 11, 0.05), (2.009575, 49, 0.05), (0.0, 7, 1.0)])
def test_student_t_table(spark, t, dof, p):
    assert one(spark, E.student_t_p(F.lit(t), F.lit(dof)).alias("p"))["p"] == pytest.approx(p, abs=1e-6)


def test_student_t_sign_and_missing(spark):
    r = one(spark, E.student_t_p(F.lit(-2.5), F.lit(9)).alias("a"), E.student_t_p(F.lit(2.5), F.lit(9)).alias("b"),
            E.student_t_p(F.lit(None).cast("double"), F.lit(9)).alias("c"))
    assert r["a"] == r["b"] and r["c"] is None


def test_clip_keeps_missing(spark):
    r = one(spark, E.clip(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0)).alias("n"),
            E.clip(F.lit(5.0), F.lit(0.0), F.lit(1.0)).alias("hi"), E.positive_part(F.lit(-2.0)).alias("pp"))
    assert (r["n"], r["hi"], r["pp"]) == (None, 1.0, 0.0)


def test_ratio_by_zero_is_null(spark):
    r = one(spark, E.ratio(F.lit(1.0), F.lit(0.0)).alias("r"), E.guarded_reciprocal(F.lit(-5.0)).alias("g"),
            E.guarded_reciprocal(F.lit(10.0)).alias("h"))
    assert (r["r"], r["g"], r["h"]) == (None, None, 0.1)


def test_labels_and_slug(spark):
    r = one(spark, E.trend_label(F.lit(0.02)).alias("a"), E.trend_label(F.lit(-0.02)).alias("b"),
            E.trend_label(F.lit(0.01)).alias("c"), E.trend_label(F.lit(None).cast("double")).alias("d"),
            E.theme_slug(F.lit("Cash generation")).alias("s"))
    assert tuple(r) == ("strengthening", "weakening", "stable", "n/a", "score__cash_generation")


def test_nan_and_infinity(spark):
    r = one(spark, E.nan_to_null(F.lit(float("nan"))).alias("a"), E.finite(F.lit(float("inf"))).alias("b"),
            E.finite(F.lit(2.0)).alias("c"))
    assert tuple(r) == (None, None, 2.0)


def exact_t_p(t, dof):
    """The finite series for even degrees of freedom in 300 digits."""
    from decimal import Decimal, getcontext
    getcontext().prec = 300
    t, nu = Decimal(t), Decimal(dof)
    cos2, total, term = nu / (nu + t * t), Decimal(1), Decimal(1)
    for k in range(1, dof // 2):
        term *= Decimal(2 * k - 1) / Decimal(2 * k) * cos2
        total += term
    return float(1 - t / (nu + t * t).sqrt() * total)


def test_student_t_tails(spark):
    cases = [(t, n) for t in (0.001, 0.5, 1.9, 2.0, 2.5, 5.0, 85.0, 1e6) for n in (2, 4, 10, 30, 198, 2000)]
    df = spark.createDataFrame(cases, "t double, n int").select("t", "n", E.student_t_p("t", "n").alias("p"))
    for r in df.collect():
        want = exact_t_p(r["t"], r["n"])
        if want > 1e-290:
            assert r["p"] == pytest.approx(want, rel=1e-6), r
    # many degrees of freedom: the normal distribution
    import math
    big = spark.createDataFrame([(t, 10 ** 9) for t in (0.5, 3.0, 10.0, 25.0)], "t double, n int").select("t", E.student_t_p("t", "n").alias("p"))
    for r in big.collect():
        assert r["p"] == pytest.approx(math.erfc(r["t"] / math.sqrt(2)), rel=1e-3 if r["t"] > 20 else 1e-5)
