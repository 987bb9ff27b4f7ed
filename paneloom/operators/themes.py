"""Themes: groups of factors scored together, their overlap and their trailing weights.

The theme map comes from the caller's own dict, so it is a handful of rows and is broadcast.
"""

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from paneloom.functions.expr import positive_part
from paneloom.vocab import THEMES


def theme_table(spark: SparkSession, themes=None) -> DataFrame:
    themes = themes or THEMES
    rows = [(t, f, len(members)) for t, members in themes.items() for f in members]
    return spark.createDataFrame(rows, "priority STRING, factor STRING, n_members_defined INT")


def score_themes(rolled: DataFrame, themes: DataFrame) -> DataFrame:
    """Mean trailing evidence of a theme's scored members per date, and its standing among the
    themes of that date. A theme without evidence has no row."""
    ev = rolled.where(F.col("rolling_ic").isNotNull()).join(F.broadcast(themes), "factor")
    ps = ev.groupBy("date", "priority").agg(
        F.avg("rolling_ic").alias("priority_score"), F.avg("rolling_spread").alias("priority_spread"),
        F.avg("strengthening_4p").alias("strengthening"), F.count(F.lit(1)).alias("n_members_scored"),
        F.max("n_members_defined").alias("n_members_defined"))
    w = W.partitionBy("date")
    s, sd = F.col("priority_score"), F.stddev_samp("priority_score").over(w)
    return ps.withColumn("priority_z", F.when(sd > 0, (s - F.avg(s).over(w)) / sd).otherwise(F.lit(0.0)))


def shared_members(themes: DataFrame, present: DataFrame) -> DataFrame:
    """(a, b, n_shared) for every two themes, through the factor they have in common. The list of
    theme pairs is made from the caller's own map (a few dozen rows)."""
    names = sorted({r[0] for r in themes.select("priority").distinct().collect()})
    pairs = themes.sparkSession.createDataFrame([(a, b) for a in names for b in names], "a STRING, b STRING")
    held = themes.join(F.broadcast(present.select("factor").distinct()), "factor", "left_semi")
    both = (held.select(F.col("priority").alias("a"), "factor")
            .join(F.broadcast(held.select(F.col("priority").alias("b"), "factor")), "factor")
            .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared")))
    return pairs.join(F.broadcast(both), ["a", "b"], "left").fillna(0, ["n_shared"])


def theme_overlap(themes: DataFrame, present: DataFrame) -> DataFrame:
    """Jaccard overlap of every two themes' present members; NULL when both are empty. A theme's
    own size is its overlap with itself."""
    shared = shared_members(themes, present)
    size = shared.where("a = b").select(F.col("a").alias("t"), F.col("n_shared").alias("n"))
    out = (shared.join(F.broadcast(size.select(F.col("t").alias("a"), F.col("n").alias("na"))), "a")
           .join(F.broadcast(size.select(F.col("t").alias("b"), F.col("n").alias("nb"))), "b"))
    return out.select("a", "b", F.try_divide(
        F.col("n_shared").cast("double"), (F.col("na") + F.col("nb") - F.col("n_shared")).cast("double"))
        .alias("jaccard"))


def trailing_theme_means(pscores: DataFrame, smoothing=4) -> DataFrame:
    """(date, priority, pos, now): positive part of each theme's mean over the last `smoothing`
    scored dates up to and including `date`; `now` tells whether the theme is scored on it.

    Scored dates are numbered and every score is handed to the dates that look back on it. All
    rows here are date x theme (calendar-bounded), so the un-keyed numbering is small."""
    everything = W.partitionBy()
    s = pscores.select("date", "priority", "priority_score",
                       F.dense_rank().over(everything.orderBy("date")).alias("i"))
    s = s.withColumn("n", F.max("i").over(everything))
    reach = s.select("date", "priority", "priority_score", "i", F.explode(F.sequence(
        "i", F.least(F.col("i") + (smoothing - 1), F.col("n")))).alias("at"))
    own = F.col("i") == F.col("at")
    mean = reach.groupBy("at", "priority").agg(
        positive_part(F.avg("priority_score")).alias("pos"), F.max(own).alias("now"),
        F.max(F.when(own, F.col("date"))).alias("__own"))
    return mean.select(F.max("__own").over(W.partitionBy("at")).alias("date"), "priority", "pos", "now")


def theme_weights(pscores: DataFrame, smoothing=4) -> DataFrame:
    """(date, priority, weight) for every scored date: trailing means normalised. When nothing is
    positive, the themes scored on that date share equally. Works on date x theme rows only."""
    w = W.partitionBy("date")
    total, present = F.sum("pos").over(w), F.count(F.when(F.col("now"), 1)).over(w)
    mean = trailing_theme_means(pscores, smoothing).withColumn(
        "weight", F.when(total > 0, F.col("pos") / total).when(F.col("now"), F.lit(1.0) / present))
    return mean.where("weight IS NOT NULL").select("date", "priority", "weight")


def disclosed_weights(weights: DataFrame, floor=0.001) -> DataFrame:
    return weights.where(F.col("weight") > floor)


def weights_per_date(weights: DataFrame) -> DataFrame:
    """One row per scored date with its theme -> weight map (as many entries as themes)."""
    return weights.groupBy("date").agg(
        F.map_from_entries(F.collect_list(F.struct("priority", "weight"))).alias("weights"))
