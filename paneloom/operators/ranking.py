"""Cross-sectional winsorising and percentile ranks."""

from pyspark.sql import DataFrame, Window as W, functions as F

from paneloom.functions.expr import clip
from paneloom.functions.ordered import (at_quantiles, average_rank, counted, group_table, null_safe_join, order_counts,
                                        quantile_parts)


def to_long(panel: DataFrame, factors, ids) -> DataFrame:
    """Wide panel to (ids, factor, value); NULL values stay so every (date, factor) is present."""
    return panel.unpivot(list(ids), [f for f in factors if f in panel.columns], "factor", "value")


def pct_rank(df: DataFrame, keys, value, out="pct_rank") -> DataFrame:
    """Average-tie rank over the group's non-missing count, in (0, 1]."""
    c = order_counts(df, keys, value, "__p_")
    return (c.withColumn(out, average_rank("__p_") / F.col("__p_total"))
            .drop("__p_below", "__p_ties", "__p_total"))


def _bounds(df, keys, value, lo, hi):
    """The group table of the value with the interpolated clip bounds, and how many rows lie at or beyond them. Only the
    rows of the few buckets that hold the bounds are ordered for it."""
    parts = {f"__{t}_{n}": e for t, q in (("lo", lo), ("hi", hi)) for n, e in quantile_parts(value, q, "__q_").items()}
    groups = group_table(df, keys, {"__q_": value})
    found = at_quantiles(df, keys, value, groups, "__q_", (lo, hi)).groupBy(*keys).agg(*[e.alias(n) for n, e in parts.items()])
    at = lambda t: F.col(f"__{t}_a") + (F.col(f"__{t}_b") - F.col(f"__{t}_a")) * F.col(f"__{t}_f")
    g = null_safe_join(groups, found, keys, "left").withColumns({"__lo": at("lo"), "__hi": at("hi")}).withColumns({
        "__n_lo": F.when(F.col("__lo") == F.col("__lo_b"), F.col("__lo_b_upto")).otherwise(F.col("__lo_a_upto")),
        "__n_hi": F.col("__total___q_") - F.when(F.col("__hi") == F.col("__hi_a"), F.col("__hi_a_below"))
        .otherwise(F.col("__hi_b_below"))})
    return g.drop(*parts)


def winsorize(df: DataFrame, keys, value, out="winsorized", lo=0.01, hi=0.99, min_n=5) -> DataFrame:
    """Clip at interpolated group quantiles; groups below min_n values are left alone. The rows themselves meet only
    the bounds of their group and are not ordered."""
    keys = list(keys)
    g = _bounds(df, keys, value, lo, hi).select(*keys, "__total___q_", "__lo", "__hi")
    v = F.col(value)
    return (null_safe_join(df, g, keys, "left")
            .withColumn(out, F.when(F.col("__total___q_") >= min_n, clip(v, "__lo", "__hi")).otherwise(v))
            .drop("__total___q_", "__lo", "__hi"))


def rank_factors(long: DataFrame, keys=("date", "factor"), value="value", sector=None,
                 lo=0.01, hi=0.99, min_n=5) -> DataFrame:
    """Winsorise within `keys`, rank within `keys` (plus sector when given). Adds `w` and `rank`.
    A row without a sector gets no sector-neutral rank.

    Clipping keeps order and only merges each tail into one tie, so the ranks after clipping
    follow from the counts before it: values are ordered once, not twice. Within sectors the tails are counted
    by one aggregation, as the bounds are those of the whole group."""
    keys = list(keys)
    v, total = F.col(value), F.col("__total___q_")
    bounds = _bounds(long, keys, value, lo, hi)
    clipped = total >= min_n
    low, high = v <= F.col("__lo"), v >= F.col("__hi")
    if sector is None:
        c = counted(long, keys, {"__q_": value}, bounds, ["__total___q_", "__lo", "__hi", "__n_lo", "__n_hi"])
        n, n_low, n_high, known = total, F.col("__n_lo"), F.col("__n_hi"), v.isNotNull()
    else:
        inner = [*keys, sector]
        bounds = bounds.select(*keys, "__total___q_", "__lo", "__hi")
        mine = long.withColumn("__s", F.when(F.col(sector).isNotNull(), v))
        tails = null_safe_join(long.select(*dict.fromkeys([*inner, value])), bounds, keys, "left").groupBy(*inner).agg(
            F.count_if(low).alias("__n_lo"), F.count_if(high).alias("__n_hi"))
        groups = null_safe_join(group_table(mine, inner, {"__p_": "__s"}), tails, inner, "left")
        c = counted(mine, inner, {"__p_": "__s"}, groups, ["__n_lo", "__n_hi"])
        c = null_safe_join(c, bounds, keys, "left")
        n, n_low, n_high, known = F.col("__p_total"), F.col("__n_lo"), F.col("__n_hi"), F.col("__s").isNotNull()
    # where the bounds meet, clipping makes all values one tie
    rank = (F.when(clipped & (F.col("__lo") == F.col("__hi")), (n + 1) / F.lit(2.0))
            .when(clipped & low, (n_low + 1) / F.lit(2.0))
            .when(clipped & high, n - (n_high - 1) / F.lit(2.0))
            .otherwise(average_rank("__q_" if sector is None else "__p_")))
    return c.select(*long.columns, F.when(clipped, clip(v, "__lo", "__hi")).otherwise(v).alias("w"),
                    F.when(known, rank / n).alias("rank"))


def factor_coverage(ranked: DataFrame, min_coverage=0.4) -> DataFrame:
    return (ranked.groupBy("factor").agg(F.avg(F.col("rank").isNotNull().cast("double")).alias("coverage"))
            .withColumn("kept", F.col("coverage") >= min_coverage))


def keep_covered(ranked: DataFrame, min_coverage=0.4) -> DataFrame:
    """Rows of the factors with enough coverage; the factor list never visits the driver."""
    kept = factor_coverage(ranked, min_coverage).where("kept").select("factor")
    return ranked.join(F.broadcast(kept), "factor", "left_semi")


def panel_coverage(panel: DataFrame, factors, sector=None, min_coverage=0.4) -> DataFrame:
    """`factor_coverage` of the ranks the panel will give, from the wide panel itself and before anything is ranked: a value
    is ranked if it is known, and its sector is where ranks are sector-neutral."""
    factors = [f for f in factors if f in panel.columns]
    known = lambda f: F.col(f).isNotNull() & (F.lit(True) if sector is None else F.col(sector).isNotNull())
    one = panel.agg(*[F.avg(known(f).cast("double")).alias(f) for f in factors])
    return one.unpivot([], factors, "factor", "coverage").withColumn("kept", F.coalesce(F.col("coverage") >= min_coverage, F.lit(False)))


def covered_long(panel: DataFrame, factors, ids, sector=None, min_coverage=0.4) -> DataFrame:
    """The long panel of the factors with enough coverage."""
    kept = panel_coverage(panel, factors, sector, min_coverage).where("kept").select("factor")  # one row a factor name given
    return to_long(panel, factors, ids).join(F.broadcast(kept), "factor", "left_semi")
