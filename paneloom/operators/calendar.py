"""Trading calendar, rebalance dates and the price grid.

The calendar is one row per distinct day in the data, so it is bounded by the days in the
covered span (about 37,000 per century): numbering it in one task and broadcasting it is safe
however many entities there are.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from paneloom.functions.expr import change, period_start


def trading_calendar(df: DataFrame, date="date") -> DataFrame:
    """(date, day_idx from 0, n_days)."""
    days = df.select(F.col(date).alias("date")).where("date IS NOT NULL").distinct()
    everything = W.partitionBy()
    return days.select(
        "date",
        (F.row_number().over(everything.orderBy("date")) - 1).alias("day_idx"),
        F.count(F.lit(1)).over(everything).cast("int").alias("n_days"))


def rebalance_dates(calendar: DataFrame, freq="Q", lookback=252, holding=63) -> DataFrame:
    """Last day of each period with `lookback` steps before it and more than `holding` after it."""
    return (calendar.groupBy(period_start("date", freq).alias("period"))
            .agg(F.max("date").alias("date"), F.max("day_idx").alias("day_idx"),
                 F.max("n_days").alias("n_days"))
            .where((F.col("day_idx") >= lookback) & (F.col("day_idx") + holding < F.col("n_days")))
            .select("date", "day_idx"))


def equal_weight_benchmark(prices: DataFrame, date="date", price="adj_close") -> DataFrame:
    """Mean price level per day, the fallback when no benchmark series exists."""
    return prices.groupBy(F.col(date).alias("date")).agg(F.avg(price).alias("bench"))


def padded_grid(df: DataFrame, entity, idx, value, lo="__lo", hi="__hi", seq=None) -> DataFrame:
    """Every entity on every step of [lo, hi] with the raw value, its forward fill and the
    pad-filled simple return. Gap steps and steps after the last sight return 0; steps before
    the first sight are NULL.

    Each observed row is stretched up to the next one, so the dense grid costs one exchange on
    the entity and no join. Of rows that repeat (entity, idx) the last in `seq` counts, or the one of
    largest value where no order is given. An entity that has no value at all is carried by one of its
    rows, stretched over all steps. The result stays partitioned by entity, so later grouping by
    (entity, ...) needs no further exchange.
    """
    w = W.partitionBy(entity).orderBy(idx)
    repeat = F.lead(idx).over(W.partitionBy(entity).orderBy(idx, F.col(seq or value).asc_nulls_first()))
    df = df.withColumn("__again", repeat).where((F.col("__again") != F.col(idx)) | F.col("__again").isNull())
    df = df.withColumn("__seen", F.count(value).over(W.partitionBy(entity))).withColumn("__rn", F.row_number().over(w))
    seen = df.where(F.col(value).isNotNull() | (F.col("__seen") == 0) & (F.col("__rn") == 1)).select(
        entity, F.col(idx).alias("__src"), F.col(value).alias("__v"), lo, hi,
        F.lag(value).over(w).alias("__prev"), F.lag(idx).over(w).alias("__before"),
        F.lead(idx).over(w).alias("__next"))
    start = F.when(F.col("__before").isNull(), F.col(lo)).otherwise(F.col("__src"))
    steps = seen.withColumn(idx, F.explode(F.sequence(
        start, F.coalesce(F.col("__next") - 1, F.col(hi)))))
    here, after = F.col(idx) == F.col("__src"), F.col(idx) > F.col("__src")
    return steps.select(
        entity, idx,
        F.when(here, F.col("__v")).alias(value),
        F.when(here | after, F.col("__v")).alias("filled"),
        F.when(here, change("__v", "__prev"))
         .when(after & (F.col("__v") != 0), F.lit(0.0)).alias("ret"))


def price_grid(prices: DataFrame, calendar: DataFrame, entity="ticker", price="adj_close", seq=None) -> DataFrame:
    on_calendar = (prices.join(F.broadcast(calendar), "date")
                   .withColumn("__lo", F.lit(0)).withColumn("__hi", F.col("n_days") - 1))
    return padded_grid(on_calendar, entity, "day_idx", price, seq=seq)
