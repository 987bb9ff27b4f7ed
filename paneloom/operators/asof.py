"""Backward as-of joins.

A join on a built-in comparison would compare every left row with every right row of its key.
Here both sides are interleaved in time order and the latest right row is carried forward, one
pass per key. Right rows are unique on (key, day) after keep-last, so what a key carries is
bounded by its days; `span_rows` further cuts the history of heavy keys into independent spans of about that many rows.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from paneloom.functions.ordered import null_safe_join
from paneloom.operators.quality import keep_last


def asof_cutoff(df: DataFrame, lag_days, date="date", out="asof_cutoff") -> DataFrame:
    return df.withColumn(out, F.date_sub(F.col(date), lag_days))


def asof_join(left: DataFrame, right: DataFrame, by, left_on, right_on, matched_as,
              seq=None, span_days=None, span_rows=None) -> DataFrame:
    """For each left row, the last right row with right_on <= left_on (same key when `by` is
    given). Whole rows match: a NULL field of the latest right row stays NULL. Unmatched left
    rows are kept. The matched right_on is returned as `matched_as`.

    span_days: process each key in spans of that many days, seeding every span with the last
    right row before it, so a key with a very long or heavy history is shared by many tasks.
    span_rows: the same for keys of more rows than that, in spans cut from a histogram of the key's days;
    where no key is that heavy, nothing but the histogram is added to the plan.
    """
    by = list(by)
    carried = [c for c in right.columns if c not in by and c != right_on and c != seq]
    right = keep_last(right.where(F.col(right_on).isNotNull()), [*by, right_on], [seq] if seq else carried)
    hit = F.struct(F.col(right_on).alias(matched_as), *carried)
    lrow = F.struct(*left.columns)
    r = right.select(*by, F.col(right_on).alias("__t"), F.lit(0).alias("__side"), hit.alias("__hit"))
    l = left.select(*by, F.col(left_on).alias("__t"), F.lit(1).alias("__side"), lrow.alias("__row"))
    part = by
    if span_days:
        span = F.floor(F.datediff(F.col("__t"), F.lit("1970-01-01").cast("date")) / span_days)
        r, l = r.withColumn("__span", span), l.withColumn("__span", span)
    elif span_rows:
        starts = span_starts(r.select(*by, "__t").unionByName(l.select(*by, "__t")), by, span_rows)
        number = F.coalesce(F.size(F.filter("__starts", lambda s: s <= F.col("__t"))), F.lit(0))
        r, l = (null_safe_join(x, starts, by).withColumn("__span", number).drop("__starts") for x in (r, l))
    if span_days or span_rows:
        r = r.unionByName(_span_seeds(r, l, by))
        part = [*by, "__span"]
    w = W.partitionBy(*part).orderBy(F.col("__t").asc_nulls_first(), "__side") \
         .rowsBetween(W.unboundedPreceding, W.currentRow)
    # a NULL time sorts first and therefore matches nothing
    both = r.unionByName(l, allowMissingColumns=True).withColumn("__hit", F.last("__hit", ignorenulls=True).over(w))
    rows = both.where("__side = 1")
    return rows.select(*[F.col(f"__row.{c}").alias(c) for c in left.columns],
                       F.col(f"__hit.{matched_as}").alias(matched_as),
                       *[F.col(f"__hit.{c}").alias(c) for c in carried])


def span_starts(rows: DataFrame, by, span_rows) -> DataFrame:
    """(by, __starts): for each key of more than `span_rows` rows the days at which a new span starts. Made from rows counted by
    key and day in the map tasks; a key has one start for each `span_rows` rows at most."""
    days = rows.where(F.col("__t").isNotNull()).groupBy(*by, "__t").agg(F.count(F.lit(1)).alias("__n"))
    run = W.partitionBy(*by).orderBy("__t").rowsBetween(W.unboundedPreceding, -1)
    days = days.withColumn("__upto", F.coalesce(F.sum("__n").over(run), F.lit(0)))
    at = days.select(*by, "__t", F.floor(F.col("__upto") / span_rows).alias("__k"),
                     F.floor(F.lag("__upto").over(W.partitionBy(*by).orderBy("__t")) / span_rows).alias("__was"))
    at = at.where(F.col("__k") > F.col("__was"))
    return at.groupBy(*by).agg(F.sort_array(F.collect_list("__t")).alias("__starts"))


def _span_seeds(r: DataFrame, l: DataFrame, by) -> DataFrame:
    """For every (key, span) the left side visits, the last right row of earlier spans.
    Works on one row per (key, span), so its size is spans, not rows."""
    ends = r.groupBy(*by, "__span").agg(F.max_by("__hit", "__t").alias("__hit"),
                                        F.max("__t").alias("__t"))
    asked = l.select(*by, "__span").distinct()
    both = (ends.withColumn("__ask", F.lit(0))
            .unionByName(asked.withColumn("__ask", F.lit(1)), allowMissingColumns=True))
    w = W.partitionBy(*by).orderBy("__span").rangeBetween(W.unboundedPreceding, -1)
    return (both.withColumn("__prev", F.last("__hit", ignorenulls=True).over(w))
            .withColumn("__prev_t", F.last("__t", ignorenulls=True).over(w))
            .where("__ask = 1 AND __prev_t IS NOT NULL")
            .select(*by, F.col("__prev_t").alias("__t"), F.lit(0).alias("__side"),
                    F.col("__prev").alias("__hit"), "__span"))


def asof_by_date(left: DataFrame, series: DataFrame, date="date", series_date="date",
                 matched_as="matched_date") -> DataFrame:
    """Un-keyed as-of of a date-keyed series: resolved on the distinct left days, then an equi-join back. Days of type
    DATE are bounded by the calendar, so they are broadcast and the left side is not shuffled; other types are not."""
    days = left.select(F.col(date).alias("__day")).distinct()
    s = series.withColumnRenamed(series_date, "__sd")
    lookup = asof_join(days, s, [], "__day", "__sd", matched_as)
    if dict(left.dtypes)[date] == "date":
        lookup = F.broadcast(lookup)
    return left.join(lookup, F.col(date).eqNullSafe(F.col("__day")), "left").drop("__day")


def fundamentals_asof(panel: DataFrame, fundamentals: DataFrame, lag_days=60, entity="ticker",
                      date="date", seq=None, span_days=None, span_rows=1_000_000) -> DataFrame:
    """Latest attributes dated at or before date - lag_days, per entity. Entities of more than `span_rows` rows are
    shared by several tasks."""
    left = asof_cutoff(panel, lag_days, date)
    out = asof_join(left, fundamentals, [entity], "asof_cutoff", date, "fundamental_date",
                    seq=seq, span_days=span_days, span_rows=span_rows)
    return out.drop("asof_cutoff")
