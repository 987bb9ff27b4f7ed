"""Input checks, keep-last de-duplication and the publication gate."""

from pyspark.sql import DataFrame, Observation, Window as W, functions as F

from paneloom.functions.digest import digest_parts, digest_text
from paneloom.session import cut_lineage
from paneloom.vocab import REQUIRED, REQUIRED_SERIES


class InputError(ValueError):
    """A critical defect of an input table."""


def require_columns(df: DataFrame, required, name="input") -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise InputError(f"{name} lacks required columns: {missing}")
    return df


def require_rows(df: DataFrame, name="input") -> DataFrame:
    if df.isEmpty():
        raise InputError(f"{name} is empty")
    return df


def column_contract(df: DataFrame, required) -> DataFrame:
    """One row per required column: is it there, and how many values does it hold?"""
    held = [c for c in required if c in df.columns]
    counts = df.agg(*[F.count(F.col(c) if c in held else F.lit(None)).alias(c) for c in required])
    long = counts.unpivot([], list(required), "column_name", "n_values")
    return long.withColumn("present", F.col("column_name").isin(held))


def row_check(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  (F.count(F.lit(1)) == 0).alias("is_empty"))


def parse_dates(df: DataFrame, raw="date", fmt="yyyy-MM-dd") -> DataFrame:
    """Text to DATE; unparseable text becomes NULL instead of failing the job."""
    return df.withColumn(raw, F.try_to_timestamp(F.col(raw), F.lit(fmt)).cast("date"))


def drop_bad_dates(df: DataFrame, date="date") -> DataFrame:
    return df.where(F.col(date).isNotNull())


def bad_date_count(df: DataFrame, date="date") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(F.col(date).isNull()).alias("n_bad_dates"))


def keep_last(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the last in `order`. The rank-limit filter is applied before the
    exchange as well, so heavily repeated keys are thinned where they are read."""
    last = [F.col(c).desc_nulls_last() for c in order]
    w = W.partitionBy(*keys).orderBy(*(last or [F.lit(1)]))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def duplicate_count(df: DataFrame, keys) -> DataFrame:
    """Rows beyond the first of each key."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"),
                       F.sum(F.col("n") - 1).alias("n_duplicates"))


def drop_nonpositive(df: DataFrame, price="adj_close") -> DataFrame:
    """A missing price is kept; only a price known to be <= 0 goes."""
    return df.where((F.col(price) > 0) | F.col(price).isNull())


def nonpositive_count(df: DataFrame, price="adj_close") -> DataFrame:
    return df.agg(F.count_if(F.col(price) <= 0).alias("n_nonpositive"))


def missing_ratios(df: DataFrame, columns=None, high=0.5, some=0.15) -> DataFrame:
    """(column_name, missing_ratio, band) in one pass over the table."""
    columns = list(columns or df.columns)
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    r = F.col("missing_ratio")
    return (one.unpivot([], columns, "column_name", "missing_ratio")
            .withColumn("band", F.when(r > high, "over half").when(r > some, "some").otherwise("ok")))


def coverage(prices: DataFrame, fundamentals: DataFrame, entity="ticker") -> DataFrame:
    """One row per entity: which of the two inputs hold it."""
    p = prices.select(entity).distinct().withColumn("__p", F.lit(True))
    f = fundamentals.select(entity).distinct().withColumn("__f", F.lit(True))
    both = p.join(f, entity, "full_outer")
    return both.select(entity, F.coalesce("__p", F.lit(False)).alias("has_prices"),
                       F.coalesce("__f", F.lit(False)).alias("has_fundamentals"))


def coverage_counts(prices: DataFrame, fundamentals: DataFrame, entity="ticker") -> DataFrame:
    p, f = F.col("has_prices"), F.col("has_fundamentals")
    return coverage(prices, fundamentals, entity).agg(
        F.count_if(p).alias("n_prices"), F.count_if(f).alias("n_fundamentals"),
        F.count_if(p & ~f).alias("n_price_only"), F.count_if(~p & f).alias("n_fundamentals_only"),
        F.count_if(p & f).alias("n_overlap"))


def reporting_gaps(df: DataFrame, entity="ticker", date="date") -> DataFrame:
    """Days since the entity's previous observation."""
    w = W.partitionBy(entity).orderBy(date)
    return df.withColumn("gap_days", F.datediff(F.col(date), F.lag(date).over(w)))


def reporting_staleness(df: DataFrame, entity="ticker", date="date", limit=130) -> DataFrame:
    """Median gap over all consecutive observations. Gaps are whole days, so the median is taken
    over the short list of distinct gaps with their counts."""
    gaps = reporting_gaps(df, entity, date).where("gap_days IS NOT NULL")
    hist = gaps.groupBy("gap_days").agg(F.count(F.lit(1)).alias("n"))
    run = W.orderBy("gap_days").rowsBetween(W.unboundedPreceding, W.currentRow)
    hist = hist.withColumn("upto", F.sum("n").over(run)).withColumn("total", F.sum("n").over(W.partitionBy()))

    def at(k):
        return F.max(F.when((F.col("upto") - F.col("n") <= k) & (k < F.col("upto")), F.col("gap_days")))

    half = (F.col("total") - 1) / F.lit(2.0)
    med = (at(F.floor(half)) + at(F.ceil(half))) / F.lit(2.0)
    return (hist.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_gaps"), med.alias("median_gap_days"))
            .withColumn("is_stale", F.coalesce(F.col("median_gap_days") > limit, F.lit(False))))


def audit_stats(tables: dict, date="date", entity="ticker") -> DataFrame:
    """Rows, entities and date range of each named table."""
    out = None
    for name, df in tables.items():
        n_ent = (F.count_distinct(F.col(entity)) if entity in df.columns else F.lit(None).cast("long"))
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), n_ent.alias("n_entities"),
                     F.min(date).alias("first_date"), F.max(date).alias("last_date"))
        one = one.select(F.lit(name).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def validate_table(df: DataFrame, name, seq) -> DataFrame:
    """Contract, dates, keep-last on the natural key, positive prices. `seq` holds input order."""
    require_columns(df, REQUIRED[name], name)
    keys = ["date", "ticker"] if "ticker" in df.columns else ["date"]
    out = keep_last(drop_bad_dates(df), keys, [seq])
    return drop_nonpositive(out) if name == "prices" else out


def load_checked(df: DataFrame, name, seq=None, keep=cut_lineage):
    """(table, audit, issues): `validate_table` applied while the table is written, with what was met on the way. One reading of
    the input: rows, date range, missing values and the digest are metrics observed as the rows pass. Without `seq` the last of
    repeated keys is the largest by its other columns. A missing column or an empty table raises.

    audit: table_name, n_rows, n_entities, first_date, last_date, payload_hash of the rows that are left.
    issues: table_name, severity, issue, observed (rows, or the share missing)."""
    require_columns(df, REQUIRED[name], name)
    spark, keys = df.sparkSession, ["date", "ticker"] if "ticker" in df.columns else ["date"]
    fields = [c for c in df.columns if c != seq]
    order = [seq] if seq else [c for c in fields if c not in keys]
    met, dated, left = Observation(), Observation(), Observation()
    missing = {f"missing {c}": F.avg(F.col(c).isNull().cast("double")) for c in fields}
    out = df.observe(met, F.count(F.lit(1)).alias("n"), F.count_if(F.col("date").isNull()).alias("bad_dates"),
                     *[e.alias(k) for k, e in missing.items()])
    out = keep_last(drop_bad_dates(out), keys, order)
    bad = F.count_if(F.col("adj_close") <= 0) if name == "prices" else F.count_if(F.lit(False))
    out = out.observe(dated, F.count(F.lit(1)).alias("n"), bad.alias("z"))
    out = drop_nonpositive(out) if name == "prices" else out
    out = out.observe(left, F.min("date").alias("first"), F.max("date").alias("last"), *[e.alias(k) for k, e in digest_parts(fields).items()])
    table = keep(out)
    if table.isEmpty():
        require_rows(df, name)  # a frame known to be empty observes nothing
    m, k, n = met.get, dated.get, left.get
    entities = F.count_distinct("ticker") if "ticker" in df.columns else F.first(F.lit(None).cast("long"))
    audit = table.agg(entities.alias("n_entities")).select(
        F.lit(name).alias("table_name"), F.lit(n["n_rows"]).alias("n_rows"), "n_entities", F.lit(n["first"]).cast("date").alias("first_date"),
        F.lit(n["last"]).cast("date").alias("last_date"), digest_text(F.lit(n["n_rows"]), F.lit(n["high"]), F.lit(n["low"])).alias("payload_hash"))
    rows = [(name, "warning", "bad dates", float(m["bad_dates"])), (name, "warning", "repeated keys", float(m["n"] - m["bad_dates"] - k["n"])),
            (name, "warning", "prices not above zero", float(k["z"]))]
    rows = [r for r in rows if r[3]]
    rows += [(name, "warning" if m[c] > 0.5 else "note", c, float(m[c])) for c in missing if m[c] > 0.15]
    issues = spark.createDataFrame(rows, "table_name STRING, severity STRING, issue STRING, observed DOUBLE")
    return table, audit, issues


# --- publication gate: one row per check -----------------------------------------------------

def _check_row(df, name, observed, threshold, passed, warn):
    return df.select(F.lit(name).alias("check_name"), observed.cast("double").alias("observed"),
                     F.lit(float(threshold)).alias("threshold"),
                     F.coalesce(passed, F.lit(False)).alias("passed"),
                     F.coalesce(warn, F.lit(False)).alias("warning"))


def latest_per_entity(prices: DataFrame, entity="ticker", date="date") -> DataFrame:
    return prices.groupBy(entity).agg(F.max(date).alias("latest"))


def _universe_latest(prices, universe, entity):
    """Universe entities with their last price day. Prices are reduced to one row per entity
    before the join, so neither side needs a size bound."""
    return universe.select(entity).distinct().join(latest_per_entity(prices, entity), entity, "left")


def gate_price_coverage(prices, universe, min_coverage=0.6, entity="ticker") -> DataFrame:
    one = _universe_latest(prices, universe, entity).agg(
        F.coalesce(F.try_divide(F.count("latest").cast("double"), F.count(F.lit(1)).cast("double")),
                   F.lit(0.0)).alias("c"))
    return _check_row(one, "price_coverage", F.col("c"), min_coverage, F.col("c") >= min_coverage, F.lit(False))


def gate_price_staleness(prices, universe, as_of, max_days=5, entity="ticker") -> DataFrame:
    """Observed = stale entities. All covered entities stale (or none covered) fails; some warn."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("latest"))
    one = _universe_latest(prices, universe, entity).agg(
        F.count("latest").alias("covered"), F.count_if(age > max_days).alias("stale"))
    ok = (F.col("covered") > 0) & (F.col("stale") < F.col("covered"))
    return _check_row(one, "price_staleness", F.col("stale"), max_days, ok, ok & (F.col("stale") > 0))


def gate_macro(macro_store, as_of, required=REQUIRED_SERIES, max_days=45) -> DataFrame:
    """One row per required series; observed = age in days, NULL when it has no observation."""
    spark = macro_store.sparkSession
    need = spark.createDataFrame([(s,) for s in required], "series_name STRING")
    last = macro_store.groupBy("series_name").agg(F.max("observation_date").alias("latest"))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("latest"))
    one = F.broadcast(need).join(last, "series_name", "left")
    return one.select(F.concat(F.lit("macro_"), F.col("series_name")).alias("check_name"),
                      age.cast("double").alias("observed"), F.lit(float(max_days)).alias("threshold"),
                      F.coalesce(age <= max_days, F.lit(False)).alias("passed"),
                      F.lit(False).alias("warning"))


def gate_fundamentals(fundamental_store, universe, as_of, min_coverage=0.5, entity="ticker") -> DataFrame:
    """Only rows already available at as_of count."""
    known = (fundamental_store.where(F.col("availability_date") <= F.lit(as_of).cast("date"))
             .select(entity).distinct().withColumn("__has", F.lit(1)))
    one = universe.select(entity).distinct().join(known, entity, "left").agg(
        F.coalesce(F.try_divide(F.count("__has").cast("double"), F.count(F.lit(1)).cast("double")),
                   F.lit(0.0)).alias("c"))
    return _check_row(one, "fundamentals_coverage", F.col("c"), min_coverage,
                      F.col("c") >= min_coverage, F.lit(False))


def _price_checks(prices, universe, as_of, min_coverage, max_days, entity="ticker") -> DataFrame:
    """Both price checks from one reading of the prices."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("latest"))
    one = _universe_latest(prices, universe, entity).agg(
        F.count("latest").alias("covered"), F.count_if(age > max_days).alias("stale"),
        F.coalesce(F.try_divide(F.count("latest").cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0)).alias("c"))
    ok = (F.col("covered") > 0) & (F.col("stale") < F.col("covered"))
    row = lambda name, observed, threshold, passed, warning: F.struct(
        F.lit(name).alias("check_name"), observed.cast("double").alias("observed"), F.lit(float(threshold)).alias("threshold"),
        F.coalesce(passed, F.lit(False)).alias("passed"), F.coalesce(warning, F.lit(False)).alias("warning"))
    both = F.array(row("price_coverage", F.col("c"), min_coverage, F.col("c") >= min_coverage, F.lit(False)),
                   row("price_staleness", F.col("stale"), max_days, ok, ok & (F.col("stale") > 0)))
    return one.select(F.explode(both).alias("r")).select("r.*")


def gate_checks(prices, macro_store, fundamental_store, universe, as_of, *, max_price_days=5,
                max_macro_days=45, min_price_coverage=0.6, min_fundamentals_coverage=0.5,
                required=REQUIRED_SERIES) -> DataFrame:
    return (_price_checks(prices, universe, as_of, min_price_coverage, max_price_days)
            .unionByName(gate_macro(macro_store, as_of, required, max_macro_days))
            .unionByName(gate_fundamentals(fundamental_store, universe, as_of, min_fundamentals_coverage)))


def gate_verdict(checks: DataFrame) -> DataFrame:
    """Passed iff no check failed; failures first, then warnings, by name."""
    names = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("check_name"))))
    return checks.agg(
        F.bool_and("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("n_failures"), F.count_if("warning").alias("n_warnings"),
        F.array_join(names(~F.col("passed")), ",").alias("failures"),
        F.array_join(names(F.col("warning")), ",").alias("warnings"))
