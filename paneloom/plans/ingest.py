"""Landed vendor files to the three stores."""

from pyspark.sql import DataFrame, SparkSession

from paneloom.operators.features import pad_change, yoy_growth
from paneloom.sources import readers, store
from paneloom.vocab import SERIES_CODES


def macro_table(series: DataFrame, names=None) -> DataFrame:
    """Series at any frequency to the monthly macro table; the price index becomes a yearly change."""
    names = list(names or SERIES_CODES.values())
    wide = readers.align_series(readers.month_end_series(series), names)
    if "cpi_index" in names:
        wide = pad_change(wide, "cpi_index", steps=12, out="cpi_yoy", scale=100.0).drop("cpi_index")
    return wide.dropna(how="all", subset=[c for c in wide.columns if c != "date"])


def fundamentals_table(metrics: DataFrame, ratios: DataFrame, seq) -> DataFrame:
    joined = readers.join_record_sets(metrics, ratios, ["ticker", "date"], seq)
    return yoy_growth(joined, "revenue_per_share").drop("revenue_per_share")


def ingest_prices(spark: SparkSession, path, prices, provider, retrieved_at=None) -> DataFrame:
    return store.ingest(spark, path, prices, lambda rows, h: store.price_rows(rows, provider, retrieved_at, h),
                        ["ticker", "date"], "date")


def ingest_macro(spark: SparkSession, path, macro, provider, retrieved_at=None) -> DataFrame:
    return store.ingest(spark, path, macro, lambda rows, h: store.macro_rows(rows, provider, retrieved_at, h),
                        ["series_name", "observation_date", "provider"], "observation_date")


def ingest_fundamentals(spark: SparkSession, path, f, provider, lag_days=60, retrieved_at=None) -> DataFrame:
    return store.ingest(spark, path, f, lambda rows, h: store.fundamental_rows(rows, provider, lag_days, retrieved_at, h),
                        ["ticker", "period_end_date", "provider"], "period_end_date")
