"""Single-regressor OLS, false-discovery control, interaction and persistence tests."""

from pyspark.sql import DataFrame, Window as W, functions as F

from paneloom import vocab
from paneloom.functions.expr import finite, student_t_p
from paneloom.functions.ordered import counted, suffix_min


def ols(df: DataFrame, keys, x, y, min_dof=3) -> DataFrame:
    """Intercept and slope with standard error, t and two-sided p per group. Only rows where both
    sides are finite take part; too few of them, or a constant x, give NULL estimates."""
    d = df.withColumn("__x", finite(x)).withColumn("__y", finite(y))
    d = d.groupBy(*keys).agg(
        F.regr_count("__y", "__x").alias("n"), F.regr_sxx("__y", "__x").alias("__sxx"),
        F.regr_syy("__y", "__x").alias("__syy"), F.regr_sxy("__y", "__x").alias("__sxy"),
        F.regr_avgx("__y", "__x").alias("__mx"), F.regr_avgy("__y", "__x").alias("__my"))
    ok = (F.col("n") - 2 >= min_dof) & (F.col("__sxx") > 0)
    d = d.withColumn("dof", (F.col("n") - 2).cast("int"))
    d = d.withColumn("beta", F.when(ok, F.try_divide("__sxy", "__sxx")))
    d = d.withColumn("alpha", F.col("__my") - F.col("beta") * F.col("__mx"))
    d = d.withColumn("__s2", F.when(ok, F.greatest(F.col("__syy") - F.col("beta") * F.col("__sxy"), F.lit(0.0))
                                    / F.col("dof")))
    d = d.withColumn("se", F.sqrt(F.try_divide("__s2", "__sxx")))
    d = d.withColumn("alpha_se", F.sqrt(F.col("__s2") * (F.lit(1.0) / F.when(ok, F.col("n"))
                                                         + F.try_divide(F.col("__mx") ** 2, F.col("__sxx")))))
    d = d.withColumn("t_stat", F.try_divide("beta", "se")).withColumn("alpha_t", F.try_divide("alpha", "alpha_se"))
    return d.select(*keys, "alpha", "alpha_se", "alpha_t", student_t_p("alpha_t", "dof").alias("alpha_p"),
                    "beta", "se", "t_stat", student_t_p("t_stat", "dof").alias("p_value"), "n", "dof")


def bh_fdr(df: DataFrame, p="p_value", family=(), out="q_value", small=False) -> DataFrame:
    """Benjamini-Hochberg q per family. A missing p stays missing and is not counted. `small` says that a family is bounded by
    construction (names x names) and fits a task: then one window gives it."""
    family, v = list(family), F.col(p)
    if small:
        whole = W.partitionBy(*family)
        upto = F.count(p).over(whole.orderBy(p).rangeBetween(W.unboundedPreceding, W.currentRow))
        c = df.withColumn("__crit", v * F.count(p).over(whole) / F.when(v.isNotNull(), upto))
        c = c.withColumn("__q", F.min("__crit").over(whole.orderBy(p).rangeBetween(W.currentRow, W.unboundedFollowing)))
    else:
        c = counted(df, family, {"__p_": p}, keep_bucket=True)
        c = c.withColumn("__crit", v * F.col("__p_total") / (F.col("__p_below") + F.col("__p_ties")))
        c = suffix_min(c, family, p, "__crit", "__q", "__p_")
    return (c.withColumn(out, F.when(v.isNotNull(), F.least(F.lit(1.0), F.col("__q"))))
            .drop("__p_below", "__p_ties", "__p_total", "__crit", "__q"))


def _finish_family(df, fdr, family_size):
    return (df.withColumn("significant_fdr", F.coalesce(F.col("q_value") <= fdr, F.lit(False)))
            .withColumn("n_tests_in_family", family_size))


def states_by_date(panel: DataFrame, states) -> DataFrame:
    """One row per date; macro columns are constant within a date, so any row will do."""
    return panel.groupBy("date").agg(*[F.max(c).alias(c) for c in states if c in panel.columns])


def pair_with_states(scores: DataFrame, states_wide: DataFrame, value="payoff_slope") -> DataFrame:
    """Every (factor, state) series on shared dates. The states are one row per date and name,
    a calendar-bounded table."""
    names = [c for c in states_wide.columns if c != "date"]
    long = states_wide.unpivot(["date"], names, "macro_state", "state")
    return scores.select("date", "factor", value).join(F.broadcast(long), "date")


def interaction_tests(scores: DataFrame, states_wide: DataFrame, min_obs=12, fdr=0.10) -> DataFrame:
    """Regress each factor's payoff slope on each macro state; untestable pairs are left out and
    the family is the pairs tested."""
    pairs = pair_with_states(scores, states_wide).where("payoff_slope IS NOT NULL AND state IS NOT NULL")
    fit = ols(pairs, ["factor", "macro_state"], "state", "payoff_slope")
    fit = fit.where((F.col("n") >= min_obs) & F.col("beta").isNotNull())
    fit = bh_fdr(fit, small=True)  # factors x states
    out = _finish_family(fit, fdr, F.count(F.lit(1)).over(W.partitionBy()))
    return out.select("factor", "macro_state", F.col("beta").alias("interaction_beta"), "t_stat", "p_value",
                      F.col("n").alias("n_periods"), F.col("alpha").alias("base_payoff"), "q_value",
                      "significant_fdr", "n_tests_in_family")


def order_by_q(tests: DataFrame) -> DataFrame:
    return tests.orderBy(F.col("q_value").asc_nulls_last(), "factor", "macro_state")


def persistence_label(beta, significant):
    return (F.when(beta.isNull(), F.lit(vocab.NO_HISTORY))
            .when(~significant, F.lit(vocab.NOISE))
            .when(beta > 0, F.lit(vocab.MOMENTUM)).otherwise(F.lit(vocab.REVERTING)))


def payoff_persistence(scores: DataFrame, lags=(1, 4), min_obs=8, fdr=0.10) -> DataFrame:
    """Regress each raw score on its own past; untestable pairs stay, with NULL estimates, and
    count towards the family size shown but not towards the correction."""
    w = W.partitionBy("factor").orderBy("date")
    past = scores.select("factor", "ic", *[F.lag("ic", k).over(w).alias(f"__past_{k}") for k in lags])
    lagged = past.select("factor", "ic", F.explode(F.array(*[
        F.struct(F.lit(k).alias("lag"), F.col(f"__past_{k}").alias("past")) for k in lags])).alias("l"))
    lagged = lagged.select("factor", "ic", "l.lag", "l.past")
    fit = ols(lagged, ["factor", "lag"], "past", "ic")
    enough = F.col("n") >= min_obs
    fit = fit.select("factor", "lag", *[F.when(enough, F.col(c)).alias(c) for c in ("beta", "t_stat", "p_value")], "n")
    out = _finish_family(bh_fdr(fit, small=True), fdr, F.count(F.lit(1)).over(W.partitionBy()))
    return out.withColumn("classification", persistence_label(F.col("beta"), F.col("significant_fdr")))
