"""Per-date evidence: rank correlation, quantile spread, payoff slope."""

from pyspark.sql import DataFrame, functions as F

from paneloom.functions.expr import pearson
from paneloom.functions.ordered import BUCKETS, average_rank, counted


def _paired_ranks(df, keys, x, y, need_y=True, buckets=BUCKETS):
    """Ranks are taken again among rows where both sides are known; both sides are cut and counted in the same readings."""
    pair = F.col(x).isNotNull() & F.col(y).isNotNull()
    d = df.withColumn("__x", F.when(pair, F.col(x))).withColumn("__y", F.when(pair, F.col(y)))
    return counted(d, keys, {"__x_": "__x", "__y_": "__y"} if need_y else {"__x_": "__x"}, buckets=buckets)


def _ic(min_n):
    rx, ry = average_rank("__x_"), average_rank("__y_")
    n = F.count("__x")
    return F.when(n >= min_n, pearson(F.covar_samp(rx, ry), F.stddev_samp(rx), F.stddev_samp(ry)))


def _spread(min_n, top, bottom):
    pr = average_rank("__x_") / F.col("__x_total")
    return F.when(F.count("__x") >= min_n,
                  F.avg(F.when(pr >= top, F.col("__y"))) - F.avg(F.when(pr <= bottom, F.col("__y"))))


def _slope(rank, min_ranks, min_pairs):
    """OLS slope on the standardised rank; the scale is over all known ranks, the fit over pairs."""
    sd = F.stddev_samp(rank)
    ok = (F.count(rank) >= min_ranks) & (sd > 0) & (F.count("__x") >= min_pairs)
    return F.when(ok, F.regr_slope("__y", "__x") * sd)


def spearman_ic(df: DataFrame, keys, x, y, min_n=10, buckets=BUCKETS) -> DataFrame:
    d = _paired_ranks(df, keys, x, y, buckets=buckets)
    return d.groupBy(*keys).agg(_ic(min_n).alias("ic"), F.count("__x").alias("n"))


def quantile_spread(df: DataFrame, keys, x, y, min_n=15, top=0.8, bottom=0.2) -> DataFrame:
    d = _paired_ranks(df, keys, x, y, need_y=False)
    return d.groupBy(*keys).agg(_spread(min_n, top, bottom).alias("spread"))


def payoff_slope(df: DataFrame, keys, rank, y, min_ranks=10, min_pairs=5) -> DataFrame:
    pair = F.col(rank).isNotNull() & F.col(y).isNotNull()
    d = df.withColumn("__x", F.when(pair, F.col(rank))).withColumn("__y", F.when(pair, F.col(y)))
    return d.groupBy(*keys).agg(_slope(rank, min_ranks, min_pairs).alias("payoff_slope"))


def score_factors(ranked: DataFrame, y="forward_excess_return", keys=("date", "factor"), rank="rank",
                  min_ic=10, min_spread=15) -> DataFrame:
    """One row for every (date, factor) of the long panel, evidence or not."""
    keys = list(keys)
    d = _paired_ranks(ranked, keys, rank, y)
    return d.groupBy(*keys).agg(
        _ic(min_ic).alias("ic"), _spread(min_spread, 0.8, 0.2).alias("spread"),
        _slope(rank, 10, 5).alias("payoff_slope"), F.count("__x").alias("n_stocks"))


def pooled_rank_correlation(ranked: DataFrame, anchor, ids=("date", "ticker"), min_n=50) -> DataFrame:
    """Rank correlation of each factor's ranks with the anchor factor's, over the pooled panel;
    given only for more than min_n shared rows. A factor pools all dates, so its rows are cut finer."""
    ids = list(ids)
    base = ranked.where(F.col("factor") == anchor).select(*ids, F.col("rank").alias("anchor_rank"))
    pairs = ranked.where(F.col("factor") != anchor).join(base, ids)
    return spearman_ic(pairs, ["factor"], "rank", "anchor_rank", min_n + 1, buckets=8 * BUCKETS) \
        .select("factor", F.col("ic").alias("rank_corr"), "n")
