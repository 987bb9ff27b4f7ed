"""The tables behind the report, the diagnostics and the control checks."""

from pyspark.sql import DataFrame, Window as W, functions as F

from paneloom.functions.expr import trend_label
from paneloom.vocab import DEFAULT_HINT, HINTS


def latest_slice(df: DataFrame, date="date") -> DataFrame:
    """Rows of the most recent date, by a scalar subquery."""
    return df.where(F.col(date) == df.agg(F.max(date)).scalar())


def current_themes(pscores: DataFrame) -> DataFrame:
    """Latest themes, best first; the first two are the headline and its runner-up."""
    d = latest_slice(pscores)
    w = W.partitionBy("date").orderBy(F.col("priority_score").desc(), "priority")
    d = d.withColumn("position", F.row_number().over(w))
    return d.select("position", "priority", "priority_score", "priority_spread",
                    trend_label("strengthening").alias("trend"),
                    F.concat_ws("/", F.col("n_members_scored").cast("string"),
                                F.col("n_members_defined").cast("string")).alias("evidence"),
                    F.when(F.col("position") == 1, "top").when(F.col("position") == 2, "runner-up")
                    .otherwise("").alias("headline"))


def factor_evidence(rolled: DataFrame) -> DataFrame:
    d = latest_slice(rolled)
    return (d.select("factor", "rolling_ic", "rolling_ic_se", "rolling_ic_t", "hit_rate",
                     trend_label("strengthening_4p").alias("trend"))
            .orderBy(F.col("rolling_ic").desc_nulls_last(), "factor"))


def persistence_table(p: DataFrame) -> DataFrame:
    flag = F.when(F.col("significant_fdr"), "significant").otherwise("not significant")
    return (p.select("factor", "lag", "beta", "t_stat", "q_value", "n",
                     F.concat_ws(" — ", flag, F.col("classification")).alias("reading"))
            .orderBy("factor", "lag"))


def hint_table(spark, hints=None) -> DataFrame:
    hints = hints or HINTS
    return spark.createDataFrame([(f, m, h) for (f, m), h in hints.items()],
                                 "factor STRING, macro_state STRING, hint STRING")


def survivors(tests: DataFrame, hints=None, default=DEFAULT_HINT) -> DataFrame:
    """Only pairs that survive the correction are worded."""
    s = tests.where("significant_fdr")
    s = s.join(F.broadcast(hint_table(tests.sparkSession, hints)), ["factor", "macro_state"], "left")
    return s.select("factor", "macro_state", "interaction_beta", "t_stat", "q_value", "n_periods",
                    "n_tests_in_family",
                    F.when(F.col("interaction_beta") > 0, "higher").otherwise("lower").alias("direction"),
                    F.coalesce("hint", F.lit(default)).alias("hint"))


def unexpected_survivors(tests: DataFrame, pairs: DataFrame, factors=()) -> DataFrame:
    """Survivors outside the expected pairs and outside factors expected on their own."""
    s = tests.where(F.col("significant_fdr") & ~F.col("factor").isin(list(factors)) if factors
                    else F.col("significant_fdr"))
    return s.join(F.broadcast(pairs), ["factor", "macro_state"], "left_anti")


def sensitivity_check(tests: DataFrame, rolled: DataFrame, pairs: DataFrame, factors: DataFrame,
                      min_t=1.5) -> DataFrame:
    """Were the expected effects recovered? pairs(factor, macro_state); factors(factor)."""
    p = F.broadcast(pairs).join(tests, ["factor", "macro_state"], "left").select(
        F.concat_ws(" x ", "factor", "macro_state").alias("expected"),
        F.when(F.col("interaction_beta").isNull(), "not run")
        .when((F.col("interaction_beta") > 0) & F.col("significant_fdr"), "recovered")
        .otherwise("not recovered").alias("status"),
        F.col("interaction_beta").alias("estimate"), "t_stat")
    f = F.broadcast(factors).join(latest_slice(rolled), "factor").select(
        F.col("factor").alias("expected"),
        F.when((F.col("rolling_ic") > 0) & (F.col("rolling_ic_t") > min_t), "recovered")
        .otherwise("weak or not recovered").alias("status"),
        F.col("rolling_ic").alias("estimate"), F.col("rolling_ic_t").alias("t_stat"))
    return p.unionByName(f)


def specificity_check(tests: DataFrame, rolled: DataFrame, max_t=2.5) -> DataFrame:
    survivors_n = tests.agg(F.count_if("significant_fdr")).scalar()
    t = latest_slice(rolled).agg(F.count_if(F.abs("rolling_ic_t") > max_t).alias("n_large_t"))
    return t.select(survivors_n.alias("n_survivors"), "n_large_t").withColumn(
        "specificity", F.when(F.col("n_survivors") == 0, "PASSED").otherwise("REVIEW NEEDED"))


def all_tests(tests: DataFrame) -> DataFrame:
    return tests.select("factor", "macro_state", "interaction_beta", "t_stat", "p_value", "q_value",
                        "significant_fdr", "n_periods").orderBy(
        F.col("q_value").asc_nulls_last(), "factor", "macro_state")


def latest_by_t(rolled: DataFrame) -> DataFrame:
    return latest_slice(rolled).select("factor", "rolling_ic", "rolling_ic_se", "rolling_ic_t", "hit_rate",
                                       "strengthening_4p").orderBy(
        F.abs("rolling_ic_t").desc_nulls_last(), "factor")
