"""Point-in-time features: price look-backs, macro states, derived attributes, sensitivity."""

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from paneloom.functions.expr import change, guarded_reciprocal, pearson, ratio
from paneloom.operators.asof import asof_by_date
from paneloom.operators.calendar import padded_grid, price_grid


# --- price look-backs ------------------------------------------------------------------------

def lookback_slices(calendar: DataFrame, rebalance: DataFrame, bench: DataFrame,
                    back=252, holding=63) -> DataFrame:
    """(date, day_idx, step, bench_ret, bench): the calendar steps each rebalance date looks at,
    step 0 being the date itself. Rows = rebalance dates x (back + 2), independent of the
    number of entities, so it is broadcast."""
    steps = rebalance.select(
        "date", F.col("day_idx").alias("__at"),
        F.explode(F.concat(F.sequence(F.lit(-back), F.lit(0)), F.array(F.lit(holding)))).alias("step"))
    steps = steps.withColumn("day_idx", F.col("__at") + F.col("step")).drop("__at")
    w = W.orderBy("day_idx")
    filled = F.last("bench", ignorenulls=True).over(w)
    b = (calendar.select("date", "day_idx").join(bench, "date", "left")
         .select("day_idx", "bench", filled.alias("__f"))
         .select("day_idx", "bench", change("__f", F.lag("__f").over(w)).alias("bench_ret")))
    return steps.join(b, "day_idx", "left")


def price_features(prices: DataFrame, calendar: DataFrame, rebalance: DataFrame, bench: DataFrame,
                   momentum=126, volatility=126, beta=252, holding=63, year=252,
                   entity="ticker", price="adj_close") -> DataFrame:
    """Momentum, low volatility, low beta and forward returns of every entity at every rebalance
    date. Returns are pad-filled; momentum and forward returns use raw prices.

    Each grid row meets only the few rebalance dates whose look-back covers it (a broadcast
    equi-join on the step), then one aggregation by (entity, date). The grid is already
    partitioned by entity, so prices are exchanged once in all.
    """
    back = max(momentum, volatility, beta)
    slices = lookback_slices(calendar, rebalance, bench, back, holding)
    step = F.col("step")
    in_vol, in_beta = step.between(-volatility, -1), step.between(-beta, -1)
    at = lambda k, c: F.max(F.when(step == k, F.col(c)))
    market = slices.groupBy("date").agg(
        F.var_samp(F.when(in_beta, F.col("bench_ret"))).alias("__bvar"),
        (ratio(at(holding, "bench"), at(0, "bench")) - 1).alias("benchmark_forward_return"))
    grid = price_grid(prices, calendar, entity, price)
    per = grid.join(F.broadcast(slices), "day_idx").groupBy(entity, "date").agg(
        at(0, price).alias("__now"), at(-momentum, price).alias("__back"), at(holding, price).alias("__fwd"),
        F.stddev_samp(F.when(in_vol, F.col("ret"))).alias("__sd"),
        F.covar_samp(F.when(in_beta, F.col("ret")), F.when(in_beta, F.col("bench_ret"))).alias("__cov"))
    fwd = change("__fwd", "__now")
    return per.join(F.broadcast(market), "date").select(
        "date", entity,
        change("__now", "__back").alias("momentum_6m"),
        (-F.col("__sd") * math.sqrt(year)).alias("low_volatility"),
        F.when(F.col("__bvar") > 0, -F.col("__cov") / F.col("__bvar")).alias("low_beta"),
        fwd.alias("forward_return"),
        (fwd - F.col("benchmark_forward_return")).alias("forward_excess_return"),
        "benchmark_forward_return")


def benchmark_on_calendar(calendar: DataFrame, macro: DataFrame, column="benchmark_adj_close") -> DataFrame:
    """Benchmark level on each trading day: the last macro row at or before it, NULL or not."""
    series = macro.select("date", F.col(column).alias("bench"))
    return asof_by_date(calendar.select("date"), series).select("date", "bench")


# --- monthly series --------------------------------------------------------------------------

def _month_no(d):
    return F.year(d) * 12 + F.month(d) - 1


def month_end_last(df: DataFrame, keys, date="date", value="value") -> DataFrame:
    """Last non-missing value of each calendar month, labelled by the month's last day."""
    return (df.where(F.col(value).isNotNull())
            .groupBy(*keys, F.last_day(date).alias("month_end"))
            .agg(F.max_by(value, date).alias(value)).withColumnRenamed("month_end", date))


def monthly_returns(prices: DataFrame, calendar: DataFrame, entity="ticker", price="adj_close") -> DataFrame:
    """(entity, month_no, price, filled, ret) on every month of the covered span."""
    m = month_end_last(prices, [entity], "date", price).withColumn("month_no", _month_no(F.col("date")))
    m = m.withColumns({"__lo": calendar.agg(_month_no(F.min("date"))).scalar(),
                       "__hi": calendar.agg(_month_no(F.max("date"))).scalar()})
    return padded_grid(m, entity, "month_no", price)


def pad_change(df: DataFrame, value, order="date", steps=1, keys=(), out="chg", scale=1.0) -> DataFrame:
    """Change over `steps` rows after filling gaps forward."""
    w = W.partitionBy(*keys).orderBy(order)
    f = df.withColumn("__f", F.last(value, ignorenulls=True).over(
        w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    c = change("__f", F.lag("__f", steps).over(w))
    return f.withColumn(out, c * scale if scale != 1.0 else c).drop("__f")


def commodity_sensitivity(prices: DataFrame, calendar: DataFrame, rebalance: DataFrame, series: DataFrame,
                          months=12, min_months=10, entity="ticker", price="adj_close",
                          value="wti_oil") -> DataFrame:
    """Correlation of monthly returns with monthly series changes over the trailing months.
    Month windows are labelled by calendar month end, so an unfinished month is left out."""
    chg = pad_change(series.select("date", value), value).where(F.col("date") == F.last_day("date"))
    chg = chg.select(_month_no(F.col("date")).alias("month_no"), "chg")
    d = F.col("date")
    newest = F.when(d == F.last_day(d), _month_no(d)).otherwise(_month_no(d) - 1)
    first = calendar.agg(_month_no(F.min("date"))).scalar()
    spans = rebalance.select("date", newest.alias("__new"), first.alias("__lo"))
    spans = spans.where(F.col("__new") >= F.col("__lo")).select("date", F.explode(F.sequence(
        F.greatest(F.col("__new") - (months - 1), F.col("__lo")), F.col("__new"))).alias("month_no"))
    spans = spans.join(chg, "month_no", "left")
    usable = spans.groupBy("date").agg(F.count(F.lit(1)).alias("__n"), F.count("chg").alias("__c")) \
        .where((F.col("__n") >= min_months) & (F.col("__c") >= min_months)).select("date")
    spans = spans.join(usable, "date", "left_semi")
    pair = F.col("ret").isNotNull() & F.col("chg").isNotNull()
    x, y = F.when(pair, F.col("ret")), F.when(pair, F.col("chg"))
    rows = monthly_returns(prices, calendar, entity, price).join(F.broadcast(spans), "month_no")
    return rows.groupBy("date", entity).agg(
        pearson(F.covar_samp(x, y), F.stddev_samp(x), F.stddev_samp(y)).alias("commodity_sensitivity"))


# --- attributes ------------------------------------------------------------------------------

def derive_factors(f: DataFrame) -> DataFrame:
    """Inverted and reciprocal attributes, so that higher is better throughout."""
    out = (f.withColumn("debt_to_equity_inv", -F.col("debt_to_equity"))
           .withColumn("earnings_yield", guarded_reciprocal("pe"))
           .withColumn("ev_ebitda_inv", guarded_reciprocal("ev_ebitda")))
    if "shares_dilution" in f.columns:
        out = out.withColumn("shares_dilution_inv", -F.col("shares_dilution"))
    return out


def yoy_growth(df: DataFrame, value, out="revenue_growth", entity="ticker", date="date", steps=4) -> DataFrame:
    return pad_change(df, value, date, steps, [entity], out)


# --- macro states (one row per date: bounded by the calendar) --------------------------------

def expanding_z(df: DataFrame, value, out, order="date", keys=(), min_periods=8) -> DataFrame:
    """Score of each value against its own history, current row included."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    z = F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w))
    return df.withColumn(out, F.when(F.count(value).over(w) >= min_periods, z))


def step_diff(df: DataFrame, value, out, steps=3, order="date", keys=()) -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value, steps).over(W.partitionBy(*keys).orderBy(order)))


def macro_states(macro: DataFrame) -> DataFrame:
    """Each state is built only when its inputs exist."""
    have, out, made = set(macro.columns), macro, []

    def add(df, name):
        made.append(name)
        return df

    if "credit_spread" in have:
        out = add(expanding_z(out, "credit_spread", "credit_spread_z"), "credit_spread_z")
    if "rate_10y" in have:
        out = add(expanding_z(out, "rate_10y", "rate_10y_z"), "rate_10y_z")
        out = add(step_diff(out, "rate_10y", "rate_10y_chg_3m", 3), "rate_10y_chg_3m")
    if {"rate_10y", "rate_2y"} <= have:
        out = out.withColumn("__curve", F.col("rate_10y") - F.col("rate_2y"))
        out = add(expanding_z(out, "__curve", "curve_z"), "curve_z")
    for src, name in (("cpi_yoy", "cpi_yoy_z"), ("vix", "vix_z")):
        if src in have:
            out = add(expanding_z(out, src, name), name)
    for src, name in (("benchmark_adj_close", "bench_trend_6m"), ("wti_oil", "wti_chg_6m")):
        if src in have:
            out = add(pad_change(out, src, steps=6, out=name), name)
    return out.select("date", *made)


def attach_macro(panel: DataFrame, states: DataFrame) -> DataFrame:
    return asof_by_date(panel, states).drop("matched_date")
