"""Composite ranking under theme weights, and its walk-forward evaluation."""

from pyspark.sql import DataFrame, Window as W, functions as F

from paneloom.operators.themes import theme_weights, weights_per_date
from paneloom.vocab import FEW_PERIODS, NO_PERIODS


def theme_ranks(ranked: DataFrame, themes: DataFrame, per_date: DataFrame, entity="ticker", y=None) -> DataFrame:
    """Mean rank of each entity's known member factors per theme, with the theme's weight, on the
    dates of `per_date` (one row per date with its weight map, so it is broadcast).

    Rows are placed by (date, entity) once, before themes multiply them, and both later
    aggregations reuse that placement. A factor outside every theme keeps its entity with a NULL
    theme."""
    cols = ["date", entity, "factor", "rank"] + ([y] if y else [])
    dated = ranked.select(*cols).join(F.broadcast(per_date), "date")
    placed = dated.repartition("date", entity)
    j = placed.join(F.broadcast(themes.select("factor", "priority")), "factor", "left")
    aggs = [F.avg("rank").alias("theme_rank"),
            F.max(F.try_element_at("weights", "priority")).alias("weight")]
    aggs += [F.max(y).alias(y)] if y else []
    return j.groupBy("date", entity, "priority").agg(*aggs)


def composite_scores(tranks: DataFrame, entity="ticker", y=None, slots=()) -> DataFrame:
    """Weighted sum of theme ranks; a missing theme adds nothing, so an entity without any rank
    scores 0 and is still ranked. `slots` lists themes whose own rank is shown beside it. The sum is exact (weights
    and ranks are at most 1), so entities with the same terms tie in whatever order these arrive."""
    term = (F.col("weight") * F.col("theme_rank")).cast("decimal(38,20)")
    aggs = [F.coalesce(F.sum(term).cast("double"), F.lit(0.0)).alias("composite_score")]
    aggs += [F.max(y).alias(y)] if y else []
    aggs += [F.max(F.when((F.col("priority") == t) & F.col("weight").isNotNull(), F.col("theme_rank")))
             .alias(slug(t)) for t in slots]
    return tranks.groupBy("date", entity).agg(*aggs)


def slug(theme: str) -> str:
    return "score__" + theme.lower().replace(" ", "_")


def top_n(scored: DataFrame, n=20, entity="ticker") -> DataFrame:
    """Best n per date, ties by entity. The limit is applied in every map task before the exchange."""
    w = W.partitionBy("date").orderBy(F.col("composite_score").desc(), entity)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def ranking_day(ranked: DataFrame, per_date: DataFrame, as_of_date=None) -> DataFrame:
    """(date, weights) of the one day to rank. An explicit day must itself be scored, else there
    is no row; the default is the latest panel day, weighted as of the last scored day when it is
    not scored itself."""
    if as_of_date is not None:
        return per_date.where(F.col("date") == F.lit(as_of_date).cast("date"))
    latest = ranked.agg(F.max("date")).scalar()
    dated = per_date.withColumn("__day", latest)
    best = dated.orderBy((F.col("date") == F.col("__day")).desc(), F.col("date").desc()).limit(1)
    return best.select(F.col("__day").alias("date"), "weights")


def composite_ranks(ranked: DataFrame, pscores: DataFrame, themes: DataFrame, n=20, as_of_date=None,
                    smoothing=4, theme_names=None, entity="ticker") -> DataFrame:
    """Top-n entities of one day: ticker, composite_score, score__<theme>..., rank, as_of_date."""
    per_date = weights_per_date(theme_weights(pscores, smoothing))
    day = ranking_day(ranked, per_date, as_of_date)
    names = theme_names or sorted(r[0] for r in themes.select("priority").distinct().collect())
    scored = composite_scores(theme_ranks(ranked, themes, day, entity), entity, slots=names)
    return top_n(scored, n, entity).select(entity, "composite_score", *[slug(t) for t in names], "rank",
                                           F.col("date").alias("as_of_date"))


def walk_forward(ranked: DataFrame, pscores: DataFrame, themes: DataFrame, n=20, smoothing=4,
                 y="forward_excess_return", entity="ticker") -> DataFrame:
    """Realised mean outcome of the top n at every scored date, all dates in one query. The cut
    comes before missing outcomes are dropped."""
    per_date = weights_per_date(theme_weights(pscores, smoothing))
    best = top_n(composite_scores(theme_ranks(ranked, themes, per_date, entity, y), entity, y), n, entity)
    return (best.groupBy("date").agg(F.count(y).alias("n_holdings"),
                                     F.avg(y).alias("portfolio_forward_excess_return"))
            .where("n_holdings > 0")
            .withColumn("hit", F.col("portfolio_forward_excess_return") > 0))


def _capped(wf: DataFrame, value, limit, min_n=4) -> DataFrame:
    """Adds the outcome with both tails capped at interpolated quantiles; fewer than min_n dates
    stay as they are. One row per date, so the whole-table frame is calendar-bounded."""
    every = W.partitionBy()
    lo, hi = (F.percentile(value, q).over(every) for q in (limit, 1 - limit))
    v = F.col(value)
    return wf.withColumn("__capped", F.when(F.count(v).over(every) < min_n, v)
                         .otherwise(F.greatest(lo, F.least(hi, v))))


def _mean_se_t(value):
    """mean, standard error and t; the last two need more than one date."""
    n = F.count(value)
    mean, se = F.avg(value), F.stddev_samp(value) / F.sqrt(F.nullif(n, F.lit(0)).cast("double"))
    return mean, F.when(n > 1, se), F.when(n > 1, F.try_divide(mean, se))


def winsorized_summary(wf: DataFrame, value="portfolio_forward_excess_return", limit=0.05) -> DataFrame:
    mean, se, t = _mean_se_t("__capped")
    return _capped(wf, value, limit).agg(mean.alias("mean_forward_excess_return_winsorized"),
                                         se.alias("se_winsorized"), t.alias("t_stat_winsorized"))


def walk_forward_summary(wf: DataFrame, limit=0.05, small=20) -> DataFrame:
    """One row, in one pass: raw and winsorised statistics side by side, and a small-sample warning."""
    v = "portfolio_forward_excess_return"
    (mean, se, t), (w_mean, w_se, w_t) = _mean_se_t(v), _mean_se_t("__capped")
    one = _capped(wf, v, limit).agg(
        F.count(F.lit(1)).alias("n_periods"), mean.alias("mean_forward_excess_return"), se.alias("se"),
        t.alias("t_stat"), F.avg(F.col("hit").cast("double")).alias("hit_rate"),
        w_mean.alias("mean_forward_excess_return_winsorized"), w_se.alias("se_winsorized"),
        w_t.alias("t_stat_winsorized"), F.lit(limit).alias("winsorize_limit"))
    n = F.col("n_periods")
    few = F.replace(F.lit(FEW_PERIODS), F.lit("{n}"), n.cast("string"))
    return one.withColumn("warning", F.when(n == 0, NO_PERIODS).when(n < small, few))
