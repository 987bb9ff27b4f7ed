"""Trailing statistics of the per-date scores. One factor's series is bounded by its dates."""

from pyspark.sql import DataFrame, Window as W, functions as F


def add_rolling_stats(scores: DataFrame, window=8, min_periods=None, factor="factor", date="date") -> DataFrame:
    """Mean, standard error, t and changes need `min_periods` known values in the window; the hit
    rate needs that many rows and counts an unknown score as a miss."""
    m = min_periods or max(3, window // 2)
    series = W.partitionBy(factor).orderBy(date)
    w = series.rowsBetween(-(window - 1), W.currentRow)
    n_ic, n_rows = F.count("ic").over(w), F.count(F.lit(1)).over(w)
    hit = F.when(F.col("ic") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    out = scores.withColumns({
        "rolling_ic": F.when(n_ic >= m, F.avg("ic").over(w)),
        "rolling_ic_se": F.when(n_ic >= m, F.stddev_samp("ic").over(w) / F.sqrt(n_ic.cast("double"))),
        "rolling_spread": F.when(F.count("spread").over(w) >= m, F.avg("spread").over(w)),
        "hit_rate": F.when(n_rows >= m, F.avg(hit).over(w)),
    })
    out = out.withColumns({
        "rolling_ic_t": F.try_divide("rolling_ic", "rolling_ic_se"),
        "strengthening_1p": F.col("rolling_ic") - F.lag("rolling_ic", 1).over(series),
        "strengthening_4p": F.col("rolling_ic") - F.lag("rolling_ic", 4).over(series),
    })
    return out.select(*scores.columns, "rolling_ic", "rolling_ic_se", "rolling_ic_t", "rolling_spread",
                      "hit_rate", "strengthening_1p", "strengthening_4p")
