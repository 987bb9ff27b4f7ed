"""The driver's tables seen as panel inputs.

Prices, attributes and macro series are whole-number sums divided once, so they are exact and
two engines rank them identically, ties included.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from paneloom.functions.expr import change, quarter_end
from paneloom.operators import calendar, features, ranking, rolling, scores, themes as th
from paneloom.session import cut_lineage, shared_folder

# chain vocabulary used by the score, theme and portfolio queries
CHAIN_FACTORS = ["f1", "f2", "f4", "mom"]
CHAIN_THEMES = {"Theme One": ["f1", "f2"], "Theme Two": ["f2", "f4"], "Theme Three": ["f1", "mom"],
                "Theme Four": ["f4", "mom", "absent_factor"]}
AS_OF = "2001-06-30"


# declared, so that opening a table starts no job
SCHEMAS = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def table(spark: SparkSession, sf_dir, name) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/paneloom-{uuid.uuid4().hex}"


def out(df: DataFrame, digits=6) -> DataFrame:
    """Comparison form: doubles rounded, whole numbers as BIGINT."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def cents(c):
    return F.round(F.col(c) * 100).cast("long")


def over(a, b):
    return a.cast("double") / b.cast("double")


def share(cond):
    return over(F.sum(F.when(cond, 1).otherwise(0)), F.count(F.lit(1)))


def price_expr():
    return over(F.sum(cents("l_extendedprice")), F.sum(F.col("l_quantity").cast("long")))


def lines(spark, d):
    return table(spark, d, "lineitem").withColumn("ship", F.to_date("l_shipdate"))


def daily(spark, d) -> DataFrame:
    return lines(spark, d).groupBy(F.col("l_suppkey").alias("ticker"), F.col("ship").alias("date")).agg(
        price_expr().alias("adj_close"), F.sum(F.col("l_quantity").cast("long")).cast("double").alias("volume"))


def days(spark, d) -> DataFrame:
    return calendar.trading_calendar(lines(spark, d), "ship")


def month_ends(spark, d) -> DataFrame:
    return calendar.trading_calendar(lines(spark, d).select(F.last_day("ship").alias("date")))


def monthly(spark, d) -> DataFrame:
    """Monthly cross-section: one row per supplier and month end, f2 missing for every 7th."""
    m = lines(spark, d).groupBy(F.col("l_suppkey").alias("ticker"), F.last_day("ship").alias("date")).agg(
        price_expr().alias("adj_close"), F.sum(F.col("l_quantity").cast("long")).cast("double").alias("volume"),
        over(F.sum(cents("l_discount")), F.count(F.lit(1))).alias("f1"),
        over(F.sum(cents("l_tax")), F.count(F.lit(1))).alias("f2"),
        share(F.col("l_returnflag") == "R").alias("f4"))
    return m.withColumn("f2", F.when(F.col("ticker") % 7 != 0, F.col("f2")))


def sectors(spark, d) -> DataFrame:
    return (table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("s_suppkey").alias("ticker"),
                    F.when(F.col("s_suppkey") % 11 != 0, F.concat(F.lit("R"), F.col("n_regionkey").cast("string")))
                    .alias("sector")))


def fundamentals(spark, d) -> DataFrame:
    n, qty = F.count(F.lit(1)), F.sum(F.col("l_quantity").cast("long"))
    f = lines(spark, d).groupBy(F.col("l_suppkey").alias("ticker"), quarter_end("ship").alias("date")).agg(
        over(F.sum(cents("l_discount")), n).alias("fcf_yield"),
        over(F.sum(cents("l_tax")), n).alias("debt_to_equity"),
        share(F.col("l_returnflag") == "R").alias("roe"),
        qty.cast("double").alias("revenue_growth"),
        (over(qty, n) - 22.0).alias("pe"),
        (over(F.sum(F.col("l_linenumber").cast("long")), n) - 3.5).alias("ev_ebitda"),
        share(F.col("l_linestatus") == "F").alias("dividend_yield"),
        n.cast("double").alias("shares_dilution"))
    f = f.withColumn("roe", F.when(F.col("ticker") % 7 != 0, F.col("roe")))
    return f.join(sectors(spark, d), "ticker", "left")


def macro(spark, d) -> DataFrame:
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    n = F.count(F.lit(1))
    m = o.groupBy(F.last_day("day").alias("date")).agg(
        over(F.sum(cents("o_totalprice")), n).alias("benchmark_adj_close"),
        (share(F.col("o_orderpriority").startswith("1-")) * 10.0).alias("rate_10y"),
        (share(F.col("o_orderstatus") == "F") * 10.0).alias("rate_2y"),
        over(F.sum(F.col("o_orderkey") % 7), n).alias("cpi_yoy"),
        over(F.sum(F.when(F.col("o_orderstatus") == "O", cents("o_totalprice"))),
             F.count(F.when(F.col("o_orderstatus") == "O", 1))).alias("wti_oil"),
        over(F.sum(F.col("o_custkey") % 100), n).alias("vix"),
        share(F.col("o_orderpriority").startswith("5-")).alias("credit_spread"))
    mon = F.month("date")
    return (m.withColumn("benchmark_adj_close", F.when(mon != 11, F.col("benchmark_adj_close")))
            .withColumn("wti_oil", F.when(mon != 3, F.col("wti_oil")))
            .withColumn("vix", F.when(mon != 7, F.col("vix"))))


def universe(spark, d) -> DataFrame:
    return table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("ticker"))


def month_no(c="date"):
    return F.year(c) * 12 + F.month(c)


def panel(spark, d) -> DataFrame:
    """Monthly panel with six-month momentum and the next month's return y."""
    w = W.partitionBy("ticker").orderBy("m")
    p = monthly(spark, d).withColumn("m", month_no())
    p = p.withColumns({
        "mom": change("adj_close", F.first("adj_close").over(w.rangeBetween(-6, -6))),
        "y": change(F.first("adj_close").over(w.rangeBetween(1, 1)), "adj_close")})
    return p.join(sectors(spark, d), "ticker", "left").select(
        "date", "ticker", "sector", "adj_close", *CHAIN_FACTORS, "y")


def long_panel(spark, d) -> DataFrame:
    """The panel is written once, as in the real run: ranking reads it several times."""
    return ranking.to_long(cut_lineage(panel(spark, d)), CHAIN_FACTORS, ["date", "ticker", "sector", "y"])


def ranked(spark, d) -> DataFrame:
    """Made once, as in the real run: scores, themes and rankings all read it."""
    return cut_lineage(ranking.rank_factors(long_panel(spark, d)))


def score_rows(spark, d, ranks=None) -> DataFrame:
    """`ranks`: what `ranked` gave, where the caller has it."""
    return scores.score_factors(ranked(spark, d) if ranks is None else ranks, "y")


def rolled(spark, d, ranks=None) -> DataFrame:
    return rolling.add_rolling_stats(score_rows(spark, d, ranks), 8)


def theme_map(spark) -> DataFrame:
    return th.theme_table(spark, CHAIN_THEMES)


def theme_scores(spark, d, ranks=None) -> DataFrame:
    return th.score_themes(rolled(spark, d, ranks), theme_map(spark))


def states(spark, d) -> DataFrame:
    return features.macro_states(macro(spark, d))


def panel_states(spark, d) -> DataFrame:
    """Macro states on the panel's dates (one row per date)."""
    return features.attach_macro(monthly(spark, d).select("date").distinct(), states(spark, d))


def macro_store(spark, d) -> DataFrame:
    """Monthly series by order status, reported by five providers."""
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return o.groupBy(F.concat(F.lit("series_"), F.lower("o_orderstatus")).alias("series_name"),
                     F.last_day("day").alias("observation_date"), F.col("o_orderpriority").alias("provider")).agg(
        over(F.sum(cents("o_totalprice")), F.count(F.lit(1))).alias("value"),
        F.max("o_orderdate").alias("retrieved_at"))
