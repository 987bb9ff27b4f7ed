"""Named queries over the driver's tables, one per operator, each with DuckDB SQL where SQL can say it."""

from pyspark.sql import DataFrame, Window as W, functions as F

from paneloom import vocab
from paneloom.functions import expr as E
from paneloom.operators import (asof, calendar as cal, features as ft, inference as inf, portfolio as pf,
                                quality as ql, ranking as rk, reports as rp, rolling as rl, scores as sc,
                                themes as th)
from paneloom.plans import ingest as ig, research
from paneloom.sources import readers as rd, store as st
from paneloom.workloads import bindings as b
from paneloom.workloads.oracle import PRICE, STATES, N, avg_rank, corr, on_full, pct, r, rel, sql, theme_values, tp

QUERIES, ORACLES = {}, {}


def q(name, oracle=None, digits=6):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: b.out(fn(spark, sf_dir), digits)
        if oracle:
            ORACLES[name] = sql(oracle)
        return fn
    return add


# --- scans, sources, sinks, reshaping --------------------------------------------------------

@q("s1_header_scan", f"SELECT CAST(ticker AS VARCHAR) AS ticker, date, {r('adj_close')}, {r('volume')} FROM daily")
def _(s, d):
    raw = b.daily(s, d).select(F.col("date").cast("string").alias(" Date"), F.col("ticker").cast("string").alias("TICKER "),
                               F.col("adj_close").cast("string").alias("Adj_Close"), F.col("volume").cast("string").alias("volume"))
    return rd.apply_contract(rd.normalise_header(raw), "date DATE, ticker STRING, adj_close DOUBLE, volume DOUBLE")


@q("s2_date_coercion", """SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) END AS date
   FROM orders WHERE o_orderkey % 50 <> 0""")
def _(s, d):
    raw = b.table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 == 0, "n/a").otherwise(
        F.to_date("o_orderdate").cast("string")).alias("date"))
    return ql.drop_bad_dates(ql.parse_dates(raw))


@q("s2_bad_date_count", "SELECT count(*) AS n_rows, count(CASE WHEN o_orderkey % 50 = 0 THEN 1 END) AS n_bad_dates FROM orders")
def _(s, d):
    raw = b.table(s, d, "orders").select(F.when(F.col("o_orderkey") % 50 == 0, "1998-13-45").otherwise(
        F.to_date("o_orderdate").cast("string")).alias("date"))
    return ql.bad_date_count(ql.parse_dates(raw))


@q("s3_series_map", f"SELECT 'vix' AS series_name, date, {r('vix AS value')} FROM macro")
def _(s, d):
    raw = b.macro(s, d).select(F.col("date").cast("string").alias("observation_date"),
                               F.coalesce(F.col("vix").cast("string"), F.lit(".")).alias("raw"))
    return rd.parse_series(raw, "vix", "observation_date", "raw")


@q("s4_wide_block", f"""SELECT date, ticker, {r('p AS adj_close', 'v AS volume')} FROM (
   SELECT ship AS date, l_returnflag AS ticker, CASE WHEN day(ship) % 5 <> 0 THEN {PRICE} END AS p,
   CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS v FROM lines GROUP BY 1,2) WHERE p IS NOT NULL""")
def _(s, d):
    g = b.lines(s, d).groupBy(F.col("ship").alias("date")).pivot("l_returnflag", ["A", "N", "R"]).agg(
        b.price_expr().alias("Close"), F.sum(F.col("l_quantity").cast("long")).cast("double").alias("Volume"))
    block = g.select("date", *[F.when(F.dayofmonth("date") % 5 != 0, F.col(f"{t}_Close")).alias(f"{t}|Close") for t in "ANR"],
                     *[F.col(f"{t}_Volume").alias(f"{t}|Volume") for t in "ANR"])
    return rd.wide_block_to_prices(block, ["A", "N", "R", "ZZZ"])


@q("s5_json_record_map", f"""SELECT event_id, user_id, {r("CAST(json_extract(props, '$.k') AS DOUBLE) AS level")},
   CAST(NULL AS DOUBLE) AS never_there FROM events""")
def _(s, d):
    return rd.map_records(b.table(s, d, "events"), "props", {"k": "level", "absent": "never_there"}, ["event_id", "user_id"])


_EV_DAY = "SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1,2"
_EV_LAST = """SELECT user_id, CAST(ts AS DATE) AS date, value FROM events
   QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id DESC) = 1"""


@q("s6_record_join", f"SELECT user_id, date, n, {r('value')} FROM ({_EV_DAY}) LEFT JOIN ({_EV_LAST}) USING (user_id, date)")
def _(s, d):
    e = b.table(s, d, "events").withColumn("date", F.to_date("ts"))
    left = e.groupBy("user_id", "date").agg(F.count(F.lit(1)).alias("n"))
    right = e.select("user_id", "date", "value", "event_id")
    return rd.join_record_sets(left, right, ["user_id", "date"], "event_id")


@q("s7_month_end_last", f"SELECT CAST(ticker AS VARCHAR) AS series_name, last_day(date) AS date, {r('arg_max(adj_close, date) AS value')} FROM daily GROUP BY 1,2")
def _(s, d):
    return rd.month_end_series(b.daily(s, d).select(F.col("ticker").cast("string").alias("series_name"), "date",
                                                    F.col("adj_close").alias("value"))).select("series_name", "date", "value")


_FLAGM = f"""SELECT last_day(ship) AS date, l_returnflag AS series_name, CASE WHEN month(ship) <> 2 THEN {N} END AS value
   FROM lines GROUP BY 1,2, month(ship)"""


@q("s8_align_series", f"""SELECT * FROM (SELECT date, {", ".join(f"max(CASE WHEN series_name='{t}' THEN value END) AS {t}" for t in "ANR")}
   FROM ({_FLAGM}) GROUP BY 1) WHERE A IS NOT NULL OR N IS NOT NULL OR R IS NOT NULL""")
def _(s, d):
    long = b.lines(s, d).groupBy(F.last_day("ship").alias("date"), F.col("l_returnflag").alias("series_name")).agg(
        F.count(F.lit(1)).cast("double").alias("value"))
    long = long.withColumn("value", F.when(F.month("date") != 2, F.col("value")))
    return rd.align_series(long, ["A", "N", "R"])


MACROS = ["benchmark_adj_close", "rate_10y", "rate_2y", "cpi_yoy", "wti_oil", "vix", "credit_spread"]
_MLONG = " UNION ALL ".join(f"SELECT date, '{c}' AS series_name, {c} AS value FROM macro WHERE {c} IS NOT NULL" for c in MACROS)


@q("s9_wide_to_long", f"SELECT date, series_name, {r('value')} FROM ({_MLONG})", digits=4)
def _(s, d):
    return rd.wide_to_long(b.macro(s, d))


ORACLES["s9_wide_to_long"] = sql(f"SELECT date, series_name, {r('value', digits=4)} FROM ({_MLONG})")


@q("s10_long_to_wide", "SELECT observation_date AS date, " + ", ".join(
    r(f"arg_max(CASE WHEN series_name='series_{t}' THEN value END, (retrieved_at, provider)) FILTER (WHERE series_name='series_{t}') AS series_{t}", digits=4)
    for t in "fop") + " FROM mstore GROUP BY 1", digits=4)
def _(s, d):
    return rd.long_to_wide(b.macro_store(s, d), ["series_f", "series_o", "series_p"])


@q("s11_universe_scan", f"SELECT ticker, date, {r('adj_close')}, {r('volume')} FROM daily WHERE ticker IN (SELECT ticker FROM univ)")
def _(s, d):
    return rd.restrict_to_universe(b.daily(s, d), b.universe(s, d))


@q("s12_universe_lines", "SELECT upper(s_name) AS ticker FROM supplier WHERE s_suppkey % 5 NOT IN (0, 1)")
def _(s, d):
    k = F.col("s_suppkey") % 5
    return rd.universe_from_lines(b.table(s, d, "supplier").select(
        F.when(k == 0, "  ").when(k == 1, F.concat(F.lit(" # "), F.col("s_name")))
        .otherwise(F.concat(F.lit("  "), F.lower("s_name"), F.lit(" "))).alias("value")))


ROLLED = ["rolling_ic", "rolling_ic_se", "rolling_ic_t", "rolling_spread", "hit_rate", "strengthening_1p", "strengthening_4p"]


@q("s14_run_tagged_scores", f"SELECT date, factor, {r('ic', 'spread', 'payoff_slope')}, n_stocks, {r(*ROLLED)}, 'run-1' AS run_id FROM ro")
def _(s, d):
    return st.tag_run(b.rolled(s, d), "run-1")


@q("s13_results_read_back", f"SELECT date, factor, {r('ic', 'spread', 'payoff_slope')}, n_stocks, fmt FROM ro CROSS JOIN (VALUES ('csv'), ('parquet')) f(fmt)")
def _(s, d):
    """Scores written as both kinds of result table, read back and put together."""
    t, out, both = b.cut_lineage(b.score_rows(s, d)), b.scratch(s), None
    for fmt in ("csv", "parquet"):
        st.write_results({"scores": t}, f"{out}/{fmt}", fmt)
        back = s.read.schema(t.schema).option("header", True).format(fmt).load(f"{out}/{fmt}/scores").withColumn("fmt", F.lit(fmt))
        both = back if both is None else both.unionByName(back)
    return both


@q("s14_published_runs", f"SELECT date, factor, {r('ic', 'spread', 'payoff_slope')}, n_stocks, 'run-1' AS run_id FROM ro")
def _(s, d):
    """One run published, another left without its commit: a reader sees the first alone."""
    t, out = b.cut_lineage(b.score_rows(s, d)), b.scratch(s)
    st.persist_run({"scores": t}, "run-1", out, st.run_row(s, "run-1", research.as_of(t), {"top_n": 20}))
    st.persist_run({"scores": t}, "run-2", out)
    return st.read_runs(s, out, "scores")


@q("s14_run_row", """SELECT 'run-1' AS run_id, max(date) AS as_of_date, '{"top_n": 20}' AS config_json,
   '[]' AS warnings_json, 'valid' AS status FROM ro""")
def _(s, d):
    return st.run_row(s, "run-1", research.as_of(b.rolled(s, d)), {"top_n": 20})


_LREST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@q("s15_keep_last", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, CAST(l_shipdate AS DATE) AS ship
   FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(c + " DESC" for c in _LREST)}) = 1""")
def _(s, d):
    k = ql.keep_last(b.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], _LREST)
    return k.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                    F.to_date("l_shipdate").alias("ship"))


@q("s16_upsert", f"""WITH o AS (SELECT * FROM events WHERE day(ts) <= 15 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1),
   n AS (SELECT * FROM events WHERE day(ts) > 15 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
   SELECT user_id, event_type, coalesce(o.event_id, n.event_id) AS first_event_id,
   {r('CASE WHEN n.event_id IS NOT NULL THEN n.value ELSE o.value END AS value')},
   CAST(coalesce(n.ts, o.ts) AS DATE) AS day FROM o FULL JOIN n USING (user_id, event_type)""")
def _(s, d):
    e = b.table(s, d, "events").select("user_id", "event_type", F.col("event_id").alias("first_event_id"), "value",
                                       "ts", "event_id")
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    old = ql.keep_last(e.where(F.dayofmonth("ts") <= 15), keys, order)
    merged = st.merge_latest(old, e.where(F.dayofmonth("ts") > 15), keys, ["value", "ts", "event_id"], order)
    return merged.select("user_id", "event_type", "first_event_id", "value", F.to_date("ts").alias("day"))


_AT = "2002-01-01 00:00:00"


@q("s16_upsert_on_disk", f"""SELECT ticker, date, {r('CASE WHEN ticker % 3 = 0 THEN 2 * adj_close ELSE adj_close END AS adj_close', 'volume')},
   CASE WHEN ticker % 3 = 0 THEN 'second' ELSE 'first' END AS provider, 64 AS hash_length FROM daily""")
def _(s, d):
    """Two deliveries of prices, the second with new values for a third of the entities; each row twice, the older first."""
    path, p = f"{b.scratch(s)}/prices", b.cut_lineage(b.daily(s, d))  # read three times
    twice = p.withColumn("input_seq", F.lit(1)).unionByName(p.withColumn("adj_close", -F.col("adj_close")).withColumn("input_seq", F.lit(0)))
    ig.ingest_prices(s, path, twice, "first", _AT)
    ig.ingest_prices(s, path, p.where(F.col("ticker") % 3 == 0).withColumn("adj_close", 2 * F.col("adj_close")), "second", "2002-01-02 00:00:00")
    return st.read_store(s, path).select("ticker", "date", "adj_close", "volume", "provider", F.length("raw_payload_hash").cast("long").alias("hash_length"))


@q("s17_ingest_prices", f"SELECT ticker, date, {r('adj_close', 'volume')}, 'vendor' AS provider, 'digest' AS raw_payload_hash, 2002 AS retrieved_year FROM daily")
def _(s, d):
    x = st.price_rows(b.daily(s, d), "vendor", _AT, "digest")
    return x.withColumn("retrieved_year", F.year("retrieved_at").cast("long")).drop("retrieved_at")


@q("s18_ingest_macro", f"SELECT series_name, date AS observation_date, {r('value', digits=4)}, 'vendor' AS provider FROM ({_MLONG})", digits=4)
def _(s, d):
    return st.macro_rows(b.macro(s, d), "vendor", _AT, "digest").select("series_name", "observation_date", "value", "provider")


@q("s19_ingest_fundamentals", f"""SELECT ticker, date AS period_end_date, CAST(date + INTERVAL 60 DAY AS DATE) AS availability_date,
   {r('fcf_yield', 'debt_to_equity', 'roe', 'pe')}, CAST(NULL AS DOUBLE) AS gross_margin, sector, 'vendor' AS provider FROM fund""")
def _(s, d):
    x = st.fundamental_rows(b.fundamentals(s, d), "vendor", 60, _AT, "digest")
    return x.select("ticker", "period_end_date", "availability_date", "fcf_yield", "debt_to_equity", "roe", "pe",
                    "gross_margin", "sector", "provider")


_MD = "md5(concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '\\N')" for c in ("l_orderkey", "l_linenumber", *_LREST)) + "))"


@q("s21_fingerprint", f"""SELECT n_rows, sha256(n_rows || '|' || a || '|' || b) AS payload_hash FROM (SELECT count(*) AS n_rows,
   CAST(sum(CAST('0x' || substr(m, 1, 16) AS UBIGINT)::HUGEINT) % 18446744073709551616 AS VARCHAR) AS a,
   CAST(sum(CAST('0x' || substr(m, 17, 16) AS UBIGINT)::HUGEINT) % 18446744073709551616 AS VARCHAR) AS b FROM (SELECT {_MD} AS m FROM lineitem))""")
def _(s, d):
    return st.fingerprint(b.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *_LREST))


# --- projections, predicates, scalar functions -----------------------------------------------

@q("p1_drop_nonpositive", f"SELECT c_custkey, {r('p AS adj_close')} FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS p FROM customer) WHERE p > 0 OR p IS NULL")
def _(s, d):
    c = b.table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("adj_close"))
    return ql.drop_nonpositive(c)


@q("p1_nonpositive_count", "SELECT count(CASE WHEN c_acctbal <= 0 THEN 1 END) AS n_nonpositive FROM customer")
def _(s, d):
    return ql.nonpositive_count(b.table(s, d, "customer"), "c_acctbal")


@q("p2_inverted_factors", f"SELECT ticker, date, {r('debt_to_equity_inv', 'shares_dilution_inv')} FROM fund2")
def _(s, d):
    return ft.derive_factors(b.fundamentals(s, d)).select("ticker", "date", "debt_to_equity_inv", "shares_dilution_inv")


@q("p3_guarded_reciprocal", f"SELECT ticker, date, {r('earnings_yield', 'ev_ebitda_inv')} FROM fund2")
def _(s, d):
    return ft.derive_factors(b.fundamentals(s, d)).select("ticker", "date", "earnings_yield", "ev_ebitda_inv")


@q("p4_curve_spread", f"SELECT date, {r('rate_10y - rate_2y AS curve')} FROM macro")
def _(s, d):
    return b.macro(s, d).select("date", (F.col("rate_10y") - F.col("rate_2y")).alias("curve"))


@q("p5_asof_cutoff", "SELECT DISTINCT ticker, date, CAST(date - INTERVAL 60 DAY AS DATE) AS asof_cutoff FROM monthly")
def _(s, d):
    return asof.asof_cutoff(b.monthly(s, d).select("ticker", "date"), 60)


@q("p6_clip", f"SELECT ticker, date, {r('CASE WHEN f2 IS NOT NULL THEN greatest(2, least(6, f2)) END AS clipped')} FROM monthly")
def _(s, d):
    return b.monthly(s, d).select("ticker", "date", E.clip("f2", F.lit(2.0), F.lit(6.0)).alias("clipped"))


@q("p7_positive_part", f"SELECT ticker, date, {r('CASE WHEN y IS NOT NULL THEN greatest(y, 0) END AS pos')} FROM panel")
def _(s, d):
    return b.panel(s, d).select("ticker", "date", E.positive_part("y").alias("pos"))


_TREND = "CASE WHEN {0} IS NULL THEN 'n/a' WHEN {0} > 0.01 THEN 'strengthening' WHEN {0} < -0.01 THEN 'weakening' ELSE 'stable' END"


@q("p8_trend_label", f"SELECT ticker, date, {_TREND.format('mom')} AS trend FROM panel")
def _(s, d):
    return b.panel(s, d).select("ticker", "date", E.trend_label("mom").alias("trend"))


@q("p9_persistence_label", """SELECT factor, lag, classification FROM pe""")
def _(s, d):
    p = inf.payoff_persistence(b.score_rows(s, d))
    return p.select("factor", "lag", inf.persistence_label(F.col("beta"), F.col("significant_fdr")).alias("classification"))


@q("p10_theme_slug", "SELECT DISTINCT p_name, 'score__' || lower(replace(p_name, ' ', '_')) AS slug FROM part")
def _(s, d):
    return b.table(s, d, "part").select("p_name").distinct().withColumn("slug", E.theme_slug("p_name"))


@q("p11_period", "SELECT DISTINCT date, CAST(date_trunc('quarter', date) AS DATE) AS quarter, CAST(date_trunc('month', date) AS DATE) AS month FROM daily")
def _(s, d):
    return b.daily(s, d).select("date").distinct().select("date", E.period_start("date", "Q").alias("quarter"),
                                                          E.period_start("date", "M").alias("month"))


@q("p13_annualised_volatility", f"SELECT ticker, {r('-stddev_samp(ret) * sqrt(252) AS low_volatility')} FROM ret_d GROUP BY 1")
def _(s, d):
    g = cal.price_grid(b.daily(s, d), b.days(s, d))
    return g.groupBy("ticker").agg((-F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("low_volatility"))


@q("p14_latest_slice", f"SELECT ticker, date, {r('adj_close', 'f1')} FROM monthly WHERE date = (SELECT max(date) FROM monthly)")
def _(s, d):
    return rp.latest_slice(b.monthly(s, d)).select("ticker", "date", "adj_close", "f1")


@q("p15_universe_predicate", "SELECT l_suppkey AS ticker, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT ticker FROM univ) GROUP BY 1")
def _(s, d):
    li = b.table(s, d, "lineitem").select(F.col("l_suppkey").alias("ticker"))
    return rd.restrict_to_universe(li, b.universe(s, d)).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


# --- data quality ----------------------------------------------------------------------------

@q("q1_required_columns", """SELECT 'l_orderkey' AS column_name, count(l_orderkey) AS n_values, true AS present FROM lineitem
   UNION ALL SELECT 'l_shipdate', count(l_shipdate), true FROM lineitem UNION ALL SELECT 'adj_close', 0, false""")
def _(s, d):
    return ql.column_contract(b.table(s, d, "lineitem"), ["l_orderkey", "l_shipdate", "adj_close"])


@q("q2_empty_input", "SELECT count(*) AS n_rows, count(*) = 0 AS is_empty FROM lineitem")
def _(s, d):
    return ql.row_check(b.table(s, d, "lineitem"))


@q("q4_duplicate_count", """SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, CAST(sum(n-1) AS BIGINT) AS n_duplicates FROM
   (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def _(s, d):
    return ql.duplicate_count(b.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


_FC = ["fcf_yield", "roe", "earnings_yield", "ev_ebitda_inv", "sector"]


@q("q5_missing_ratios", f"SELECT column_name, {r('missing_ratio')}, CASE WHEN missing_ratio > 0.5 THEN 'over half' WHEN missing_ratio > 0.15 THEN 'some' ELSE 'ok' END AS band FROM ("
   + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(count(CASE WHEN {c} IS NULL THEN 1 END) AS DOUBLE)/count(*) AS missing_ratio FROM fund2" for c in _FC) + ")")
def _(s, d):
    return ql.missing_ratios(ft.derive_factors(b.fundamentals(s, d)), _FC)


_PX_T = "SELECT DISTINCT ticker FROM daily"
_FD_T = "SELECT DISTINCT o_custkey AS ticker FROM orders"


def _two_inputs(s, d):
    """Suppliers that ship and customers that order: two key sets that overlap only in part."""
    return b.daily(s, d), b.table(s, d, "orders").select(F.col("o_custkey").alias("ticker"))


@q("q6_coverage", f"""SELECT count(p.ticker) AS n_prices, count(f.ticker) AS n_fundamentals,
   count(CASE WHEN f.ticker IS NULL THEN 1 END) AS n_price_only, count(CASE WHEN p.ticker IS NULL THEN 1 END) AS n_fundamentals_only,
   count(CASE WHEN p.ticker IS NOT NULL AND f.ticker IS NOT NULL THEN 1 END) AS n_overlap
   FROM ({_PX_T}) p FULL JOIN ({_FD_T}) f ON p.ticker = f.ticker""")
def _(s, d):
    return ql.coverage_counts(*_two_inputs(s, d))


@q("q7_reporting_staleness", f"""SELECT count(g) AS n_gaps, {r('median(g) AS median_gap_days')}, median(g) > 130 AS is_stale FROM
   (SELECT date_diff('day', lag(date) OVER (PARTITION BY ticker ORDER BY date), date) AS g FROM fund)""")
def _(s, d):
    return ql.reporting_staleness(b.fundamentals(s, d))


@q("q8_audit_stats", """SELECT 'prices' AS table_name, count(*) AS n_rows, count(DISTINCT ticker) AS n_entities, min(date) AS first_date, max(date) AS last_date FROM daily
   UNION ALL SELECT 'fundamentals', count(*), count(DISTINCT ticker), min(date), max(date) FROM fund
   UNION ALL SELECT 'macro', count(*), NULL, min(date), max(date) FROM macro""")
def _(s, d):
    return ql.audit_stats({"prices": b.daily(s, d), "fundamentals": b.fundamentals(s, d), "macro": b.macro(s, d)})


_Q8D = "(SELECT CASE WHEN day(date) = 1 THEN NULL ELSE date END AS date, ticker, CASE WHEN ticker % 10 = 0 THEN -adj_close ELSE adj_close END AS adj_close, CASE WHEN ticker % 3 = 0 THEN volume END AS volume FROM daily)"
_Q8K = f"(SELECT * FROM {_Q8D} WHERE date IS NOT NULL)"
_Q8M = "md5(concat_ws('|', CAST(date AS VARCHAR), CAST(ticker AS VARCHAR), '1.5', coalesce(CAST(volume AS VARCHAR), '\\N')))"
_Q8H = f"""(SELECT sha256(count(*) || '|' || CAST(sum(CAST('0x' || substr(m, 1, 16) AS UBIGINT)::HUGEINT) % 18446744073709551616 AS VARCHAR) || '|' ||
   CAST(sum(CAST('0x' || substr(m, 17, 16) AS UBIGINT)::HUGEINT) % 18446744073709551616 AS VARCHAR)) FROM (SELECT {_Q8M} AS m FROM {_Q8K} WHERE adj_close > 0))"""


@q("q8_checked_load", f"""SELECT 'audit' AS kind, 'prices' AS name, CAST(count(*) AS DOUBLE) AS n, count(DISTINCT ticker) AS n_entities, min(date) AS first_date, max(date) AS last_date,
   {_Q8H} AS payload_hash FROM {_Q8K} WHERE adj_close > 0
   UNION ALL SELECT 'warning', 'bad dates', count(*), NULL, NULL, NULL, NULL FROM (SELECT * FROM {_Q8D} UNION ALL SELECT * FROM {_Q8D} WHERE ticker % 4 = 1) WHERE date IS NULL
   UNION ALL SELECT 'warning', 'repeated keys', count(*), NULL, NULL, NULL, NULL FROM {_Q8K} WHERE ticker % 4 = 1
   UNION ALL SELECT 'warning', 'prices not above zero', count(*), NULL, NULL, NULL, NULL FROM {_Q8K} WHERE adj_close <= 0
   UNION ALL SELECT 'warning', 'missing volume', round(avg(CASE WHEN volume IS NULL THEN 1.0 ELSE 0 END), 6), NULL, NULL, NULL, NULL FROM (SELECT * FROM {_Q8D} UNION ALL SELECT * FROM {_Q8D} WHERE ticker % 4 = 1)""")
def _(s, d):
    """Prices with bad dates, repeated keys, prices below zero and missing volumes, checked while they are written."""
    p = b.daily(s, d).select(F.when(F.dayofmonth("date") != 1, F.col("date")).alias("date"), "ticker",
                             F.when(F.col("ticker") % 10 == 0, -1.5).otherwise(1.5).alias("adj_close"),
                             F.when(F.col("ticker") % 3 == 0, F.col("volume")).alias("volume"), F.lit(1).alias("seq"))
    p = p.unionByName(p.where("ticker % 4 = 1").withColumn("seq", F.lit(0)))
    _, audit, issues = ql.load_checked(p, "prices", "seq")
    return audit.select(F.lit("audit").alias("kind"), F.col("table_name").alias("name"), F.col("n_rows").cast("double").alias("n"), "n_entities",
                        "first_date", "last_date", "payload_hash").unionByName(
        issues.select(F.col("severity").alias("kind"), F.col("issue").alias("name"), F.col("observed").alias("n")), allowMissingColumns=True)


_GATE_DAY = "2001-11-20"
_GU = "SELECT ticker, (SELECT max(date) FROM daily p WHERE p.ticker = univ.ticker) AS latest FROM univ"
_G9 = f"SELECT 'price_coverage' AS check_name, CAST(count(latest) AS DOUBLE)/count(*) AS observed, CAST(0.6 AS DOUBLE) AS threshold, CAST(count(latest) AS DOUBLE)/count(*) >= 0.6 AS passed, false AS warning FROM ({_GU})"
_G10 = f"""SELECT 'price_staleness' AS check_name, CAST(st AS DOUBLE) AS observed, CAST(5 AS DOUBLE) AS threshold, c > 0 AND st < c AS passed, c > 0 AND st < c AND st > 0 AS warning
   FROM (SELECT count(latest) AS c, count(CASE WHEN date_diff('day', latest, DATE '{_GATE_DAY}') > 5 THEN 1 END) AS st FROM ({_GU}))"""
_G11 = f"""SELECT 'macro_' || s AS check_name, CAST(date_diff('day', l, DATE '{_GATE_DAY}') AS DOUBLE) AS observed, CAST(45 AS DOUBLE) AS threshold,
   coalesce(date_diff('day', l, DATE '{_GATE_DAY}') <= 45, false) AS passed, false AS warning
   FROM (SELECT s, (SELECT max(observation_date) FROM mstore WHERE series_name = s) AS l FROM (VALUES ('series_f'), ('series_o'), ('series_x')) v(s))"""
_G12 = f"""SELECT 'fundamentals_coverage' AS check_name, c AS observed, CAST(0.5 AS DOUBLE) AS threshold, c >= 0.5 AS passed, false AS warning FROM
   (SELECT CAST(count(CASE WHEN ticker IN (SELECT ticker FROM fund WHERE date + INTERVAL 60 DAY <= DATE '1995-06-30') THEN 1 END) AS DOUBLE)/count(*) AS c FROM univ)"""
_GR = "check_name, " + r("observed", "threshold") + ", passed, warning"
_NEED = ["series_f", "series_o", "series_x"]


def _fund_store(s, d):
    return st.fundamental_rows(b.fundamentals(s, d), "vendor", 60, _AT, "digest")


@q("q9_gate_price_coverage", f"SELECT {_GR} FROM ({_G9})")
def _(s, d):
    return ql.gate_price_coverage(b.daily(s, d), b.universe(s, d))


@q("q10_gate_price_staleness", f"SELECT {_GR} FROM ({_G10})")
def _(s, d):
    return ql.gate_price_staleness(b.daily(s, d), b.universe(s, d), _GATE_DAY)


@q("q11_gate_macro", f"SELECT {_GR} FROM ({_G11})")
def _(s, d):
    return ql.gate_macro(b.macro_store(s, d), _GATE_DAY, _NEED)


@q("q12_gate_fundamentals", f"SELECT {_GR} FROM ({_G12})")
def _(s, d):
    return ql.gate_fundamentals(_fund_store(s, d), b.universe(s, d), "1995-06-30")


@q("q13_gate_verdict", f"""SELECT bool_and(passed) AS passed, count(CASE WHEN NOT passed THEN 1 END) AS n_failures, count(CASE WHEN warning THEN 1 END) AS n_warnings,
   coalesce(string_agg(CASE WHEN NOT passed THEN check_name END, ',' ORDER BY check_name), '') AS failures,
   coalesce(string_agg(CASE WHEN warning THEN check_name END, ',' ORDER BY check_name), '') AS warnings
   FROM ({_G9} UNION ALL {_G10} UNION ALL {_G11} UNION ALL {_G12.replace('1995-06-30', _GATE_DAY)})""")
def _(s, d):
    return ql.gate_verdict(ql.gate_checks(b.daily(s, d), b.macro_store(s, d),
                                          _fund_store(s, d), b.universe(s, d), _GATE_DAY, required=_NEED))


# --- joins -----------------------------------------------------------------------------------

_J1C = ["fcf_yield", "roe", "pe"]
_J1 = f"""SELECT p.ticker, p.date, f.date AS fundamental_date, {r('f.fcf_yield AS fcf_yield', 'f.roe AS roe', 'f.pe AS pe')}
   FROM (SELECT ticker, date, CAST(date - INTERVAL 60 DAY AS DATE) AS cut FROM monthly) p
   ASOF LEFT JOIN (SELECT ticker, date, fcf_yield, CASE WHEN month(date) <> 6 THEN roe END AS roe, pe FROM fund) f
   ON p.ticker = f.ticker AND p.cut >= f.date"""


def _j1(s, d, **kw):
    f = b.fundamentals(s, d).select("ticker", "date", "fcf_yield", F.when(F.month("date") != 6, F.col("roe")).alias("roe"), "pe")
    return asof.fundamentals_asof(b.monthly(s, d).select("ticker", "date"), f, 60, **kw).select(
        "ticker", "date", "fundamental_date", *_J1C)


@q("j1_asof_by_key", _J1)
def _(s, d):
    return _j1(s, d)


@q("j1_asof_in_spans", _J1)
def _(s, d):
    return _j1(s, d, span_days=365)


@q("j1_asof_heavy_keys", _J1)
def _(s, d):
    """Every key heavier than a handful of rows is cut into spans."""
    return _j1(s, d, span_rows=5)


@q("j2_attach_macro", f"""SELECT p.ticker, p.date, {r(*[f'm.{c} AS {c}' for c in STATES])} FROM monthly p
   LEFT JOIN (SELECT a.date AS pd, ms.* FROM (SELECT DISTINCT date FROM monthly) a ASOF LEFT JOIN ms ON a.date >= ms.date) m ON m.pd = p.date""")
def _(s, d):
    return ft.attach_macro(b.monthly(s, d).select("ticker", "date"), b.states(s, d))


@q("j3_benchmark_on_calendar", f"SELECT date, {r('bench', digits=3)} FROM bench_d", digits=3)
def _(s, d):
    return ft.benchmark_on_calendar(b.days(s, d), b.macro(s, d))


@q("j4_sensitivity_join", f"SELECT p.date, p.ticker, {r('momentum_6m', 'commodity_sensitivity')} FROM pfm p LEFT JOIN cs_m c ON c.date = p.date AND c.ticker = p.ticker")
def _(s, d):
    return _price_panel(s, d).select("date", "ticker", "momentum_6m").join(_sens(s, d, "M"), ["date", "ticker"], "left")


@q("j5_exact_date_join", f"""SELECT c.date, {r('chg')} FROM (SELECT DISTINCT date FROM monthly) c LEFT JOIN wchg w ON w.date = c.date""")
def _(s, d):
    chg = ft.pad_change(b.macro(s, d).select("date", "wti_oil"), "wti_oil").select("date", "chg")
    return b.monthly(s, d).select("date").distinct().join(F.broadcast(chg), "date", "left")


@q("j6_factor_state_pairs", f"SELECT date, factor, macro_state, {r('payoff_slope', 'state')} FROM ip")
def _(s, d):
    return inf.pair_with_states(b.score_rows(s, d), b.panel_states(s, d)).select("date", "factor", "macro_state", "payoff_slope", "state")


@q("j7_theme_membership", f"SELECT date, priority, factor, {r('rolling_ic')} FROM ro JOIN tm USING (factor)")
def _(s, d):
    return b.rolled(s, d).join(F.broadcast(b.theme_map(s)), "factor").select("date", "priority", "factor", "rolling_ic")


@q("j8_rank_to_outcome", f"SELECT date, ticker, rank, {r('y')} FROM topn")
def _(s, d):
    per_date = th.weights_per_date(th.theme_weights(b.theme_scores(s, d)))
    tr = pf.theme_ranks(b.ranked(s, d), b.theme_map(s), per_date, y="y")
    return pf.top_n(pf.composite_scores(tr, y="y"), 20).select("date", "ticker", "rank", "y")


_HINTS = {("f1", "credit_spread_z"): "first wording", ("mom", "vix_z"): "second wording"}


@q("j9_hint_lookup", f"""SELECT factor, macro_state, {r('interaction_beta')}, CASE WHEN factor='f1' AND macro_state='credit_spread_z' THEN 'first wording'
   WHEN factor='mom' AND macro_state='vix_z' THEN 'second wording' ELSE 'none' END AS hint FROM it""")
def _(s, d):
    t = inf.interaction_tests(b.score_rows(s, d), b.panel_states(s, d))
    return t.join(F.broadcast(rp.hint_table(s, _HINTS)), ["factor", "macro_state"], "left").select(
        "factor", "macro_state", "interaction_beta", F.coalesce("hint", F.lit("none")).alias("hint"))


@q("j10_members_present", "SELECT priority, factor FROM tm WHERE factor IN (SELECT DISTINCT factor FROM lp WHERE value IS NOT NULL)")
def _(s, d):
    have = b.long_panel(s, d).where("value IS NOT NULL").select("factor").distinct()
    return b.theme_map(s).join(F.broadcast(have), "factor", "left_semi").select("priority", "factor")


_EXP = [("f1", "credit_spread_z"), ("f2", "vix_z"), ("mom", "rate_10y_z")]
_EXPV = "(VALUES " + ", ".join(f"('{a}','{m}')" for a, m in _EXP) + ") x(factor, macro_state)"


def _expected(s):
    return s.createDataFrame(_EXP, "factor STRING, macro_state STRING")


def _wide_fdr(s, d):
    """Tests flagged at a loose threshold so that the survivor tables have rows."""
    return inf.interaction_tests(b.score_rows(s, d), b.panel_states(s, d), fdr=0.95)


_IT95 = "(SELECT * REPLACE (q_value <= 0.95 AS significant_fdr) FROM it)"


@q("j11_unexpected_survivors", f"""SELECT factor, macro_state, {r('q_value')} FROM {_IT95} t WHERE significant_fdr AND factor <> 'f4'
   AND NOT EXISTS (SELECT 1 FROM {_EXPV} WHERE x.factor = t.factor AND x.macro_state = t.macro_state)""")
def _(s, d):
    return rp.unexpected_survivors(_wide_fdr(s, d), _expected(s), ["f4"]).select("factor", "macro_state", "q_value")


@q("j12_trailing_dates", f"SELECT date, priority, {r('pos')}, cur AS scored_now FROM tw0")
def _(s, d):
    ps = b.theme_scores(s, d)
    return th.trailing_theme_means(ps, 4).select("date", "priority", "pos", F.col("now").alias("scored_now"))


# --- aggregations ----------------------------------------------------------------------------

@q("a1_rebalance_calendar", "SELECT date, i AS day_idx FROM reb_d")
def _(s, d):
    return cal.rebalance_dates(b.days(s, d), "Q", 252, 63)


@q("a1_rebalance_monthly", "SELECT max(date) AS date, max(i) AS day_idx FROM cal_d GROUP BY date_trunc('month', date) HAVING max(i) >= 252 AND max(i) + 63 < max(n)")
def _(s, d):
    return cal.rebalance_dates(b.days(s, d), "M", 252, 63)


@q("a2_equal_weight_benchmark", f"SELECT date, {r('avg(adj_close) AS bench', digits=4)} FROM daily GROUP BY 1", digits=4)
def _(s, d):
    return cal.equal_weight_benchmark(b.daily(s, d))


_IC_RAW = f"""SELECT date, CASE WHEN count(*) >= 10 THEN {corr('rx', 'ry')} END AS ic, count(*) AS n FROM
   (SELECT date, {avg_rank('date', 'f1')} AS rx, {avg_rank('date', 'y')} AS ry FROM panel WHERE f1 IS NOT NULL AND y IS NOT NULL) GROUP BY 1"""


_IC = f"SELECT date, {r('ic')}, coalesce(n, 0) AS n FROM (SELECT DISTINCT date FROM panel) LEFT JOIN ({_IC_RAW}) USING (date)"


@q("a3_rank_ic", _IC)
def _(s, d):
    return sc.spearman_ic(b.panel(s, d), ["date"], "f1", "y")


@q("a3_rank_ic_split", _IC)
def _(s, d):
    return sc.spearman_ic(b.panel(s, d), ["date"], "f1", "y")


_GRID = "(SELECT DISTINCT date, factor FROM lp)"


@q("a4_quintile_spread", f"SELECT date, factor, {r('spread')} FROM {_GRID} LEFT JOIN sps USING (date, factor)")
def _(s, d):
    return sc.quantile_spread(b.ranked(s, d), ["date", "factor"], "rank", "y")


@q("a5_payoff_slope", f"SELECT date, factor, {r('payoff_slope')} FROM {_GRID} LEFT JOIN sls USING (date, factor)")
def _(s, d):
    return sc.payoff_slope(b.ranked(s, d), ["date", "factor"], "rank", "y")


_SC = f"SELECT date, factor, {r('ic', 'spread', 'payoff_slope')}, n_stocks FROM sc"


@q("a6_factor_scores", _SC)
def _(s, d):
    return b.score_rows(s, d)


@q("a6_factor_scores_split", _SC)
def _(s, d):
    return b.score_rows(s, d)


_OLSC = ["alpha", "alpha_se", "alpha_t", "alpha_p", "beta", "se", "t_stat", "p_value"]


@q("a7_ols", f"SELECT factor, macro_state, {r(*_OLSC)}, n, dof FROM fit")
def _(s, d):
    return inf.ols(inf.pair_with_states(b.score_rows(s, d), b.panel_states(s, d)).where("payoff_slope IS NOT NULL AND state IS NOT NULL"),
                   ["factor", "macro_state"], "state", "payoff_slope")


_TP = "SELECT ticker, nu, tv FROM (SELECT ticker, 1 + month(date) + year(date) % 40 AS nu, mom * 5 AS tv FROM panel)"


@q("a8_student_t_p", f"SELECT ticker, nu AS dof, {r('tv AS t', tp('tv', 'nu') + ' AS p')} FROM ({_TP})")
def _(s, d):
    x = b.panel(s, d).select("ticker", (1 + F.month("date") + F.year("date") % 40).alias("dof"), (F.col("mom") * 5).alias("t"))
    return x.withColumn("p", E.student_t_p("t", "dof"))


@q("a9_factor_coverage", f"SELECT factor, {r('c AS coverage')}, c >= 0.9 AS kept FROM (SELECT factor, CAST(count(rank) AS DOUBLE)/count(*) AS c FROM rk GROUP BY 1)")
def _(s, d):
    return rk.factor_coverage(b.ranked(s, d), 0.9)


_PSC = ["priority_score", "priority_spread", "strengthening"]
_PS = f"SELECT date, priority, {r(*_PSC)}, n_members_scored, n_members_defined, {r('priority_z')} FROM ps"


@q("a10_theme_scores", _PS)
def _(s, d):
    return b.theme_scores(s, d)


_THN = list(b.CHAIN_THEMES)
_OV = """SELECT a, b, CASE WHEN na + nb - s > 0 THEN CAST(s AS DOUBLE) / (na + nb - s) END AS j FROM (SELECT a, b,
   (SELECT count(*) FROM pm x JOIN pm y USING (factor) WHERE x.priority = a AND y.priority = b) AS s,
   (SELECT count(*) FROM pm WHERE priority = a) AS na, (SELECT count(*) FROM pm WHERE priority = b) AS nb
   FROM (SELECT DISTINCT priority AS a FROM tm), (SELECT DISTINCT priority AS b FROM tm))"""
_PM = "WITH pm AS (SELECT * FROM tm WHERE factor IN (SELECT DISTINCT factor FROM lp WHERE value IS NOT NULL)) "


@q("a11_theme_overlap", f"SELECT a, b, {r('j AS jaccard')} FROM ({_PM}{_OV})")
def _(s, d):
    return th.theme_overlap(b.theme_map(s), b.long_panel(s, d).where("value IS NOT NULL").select("factor").distinct())


@q("a12_theme_weights", f"SELECT date, priority, {r('weight')} FROM tw")
def _(s, d):
    return th.theme_weights(b.theme_scores(s, d))


@q("a12_disclosed_weights", f"SELECT date, priority, {r('weight')} FROM tw WHERE weight > 0.001")
def _(s, d):
    return th.disclosed_weights(th.theme_weights(b.theme_scores(s, d)))


@q("a13_composite", f"SELECT date, ticker, {r('composite_score')} FROM cs WHERE date IN (SELECT date FROM tw)")
def _(s, d):
    per_date = th.weights_per_date(th.theme_weights(b.theme_scores(s, d)))
    return pf.composite_scores(pf.theme_ranks(b.ranked(s, d), b.theme_map(s), per_date))


_WF = f"SELECT date, n_holdings, {r('portfolio_forward_excess_return')}, hit FROM wf"


def _wf(s, d):
    ranks = b.ranked(s, d)
    return pf.walk_forward(ranks, b.theme_scores(s, d, ranks), b.theme_map(s), 20, y="y")


@q("a14_walk_forward", _WF)
def _(s, d):
    return _wf(s, d)


_RAW = """SELECT count(*) AS n_periods, avg(p) AS m, stddev_samp(p)/sqrt(count(*)) AS se, avg(CAST(CAST(hit AS INT) AS DOUBLE)) AS h
   FROM (SELECT portfolio_forward_excess_return AS p, hit FROM wf)"""
_CAP = """SELECT avg(c) AS wm, stddev_samp(c)/sqrt(count(*)) AS wse FROM (SELECT CASE WHEN (SELECT count(*) FROM wf) < 4 THEN p ELSE
   greatest((SELECT quantile_cont(portfolio_forward_excess_return, 0.05) FROM wf), least((SELECT quantile_cont(portfolio_forward_excess_return, 0.95) FROM wf), p)) END AS c
   FROM (SELECT portfolio_forward_excess_return AS p FROM wf))"""


@q("a15_walk_forward_summary", f"""SELECT n_periods, {r('m AS mean_forward_excess_return', 'se', 'm/nullif(se,0) AS t_stat', 'h AS hit_rate',
   'wm AS mean_forward_excess_return_winsorized', 'wse AS se_winsorized', 'wm/nullif(wse,0) AS t_stat_winsorized')}, CAST(0.05 AS DOUBLE) AS winsorize_limit,
   CASE WHEN n_periods = 0 THEN 'No rebalance periods had enough trailing history to evaluate.' WHEN n_periods < 20 THEN 'Only ' || n_periods ||
   ' real historical rebalance period(s) available -- treat this as exploratory, not a validated backtest, until more real history accumulates.' END AS warning
   FROM ({_RAW}), ({_CAP})""")
def _(s, d):
    return pf.walk_forward_summary(_wf(s, d))


@q("a16_winsorised_summary", f"SELECT {r('wm AS mean_forward_excess_return_winsorized', 'wse AS se_winsorized', 'wm/nullif(wse,0) AS t_stat_winsorized')} FROM ({_CAP})")
def _(s, d):
    return pf.winsorized_summary(_wf(s, d))


@q("a17_latest_per_entity", "SELECT ticker, max(date) AS latest FROM daily GROUP BY 1")
def _(s, d):
    return ql.latest_per_entity(b.daily(s, d))


@q("a18_distinct_entities", "SELECT count(DISTINCT l_suppkey) AS n_entities, count(DISTINCT CAST(l_shipdate AS DATE)) AS n_days FROM lineitem")
def _(s, d):
    return b.lines(s, d).agg(F.count_distinct("l_suppkey").alias("n_entities"), F.count_distinct("ship").alias("n_days"))


def _sens(s, d, freq="D"):
    days = b.days(s, d)
    dates = (cal.rebalance_dates(b.month_ends(s, d), "Q", 12, 3) if freq == "M" else cal.rebalance_dates(days, "Q", 252, 63))
    return ft.commodity_sensitivity(b.daily(s, d), days, dates, b.macro(s, d))


@q("a19_commodity_sensitivity", f"SELECT date, ticker, {r('commodity_sensitivity')} FROM cs_d")
def _(s, d):
    return _sens(s, d)


@q("a20_pooled_rank_correlation", f"""SELECT factor, {r(f"CASE WHEN count(*) >= 51 THEN {corr('rx','ry')} END AS rank_corr")}, count(*) AS n FROM
   (SELECT a.factor, {avg_rank('a.factor', 'a.rank')} AS rx, {avg_rank('a.factor', 'z.rank')} AS ry FROM rk a JOIN rk z ON z.date = a.date AND z.ticker = a.ticker
    AND z.factor = 'f1' WHERE a.factor <> 'f1' AND a.rank IS NOT NULL AND z.rank IS NOT NULL) GROUP BY 1""")
def _(s, d):
    return sc.pooled_rank_correlation(b.ranked(s, d), "f1")


# --- inference -------------------------------------------------------------------------------

def _bh_in(s, d):
    """A p-like number per supplier and month, ties and missing values included; one family per month."""
    return b.monthly(s, d).select("ticker", "date", F.when(F.col("ticker") % 7 != 0, F.col("f4")).alias("p_value"))


_BH = f"""SELECT ticker, date, {r('p_value', 'q AS q_value')} FROM (SELECT *, CASE WHEN p_value IS NOT NULL THEN least(CAST(1 AS DOUBLE),
   min(p_value*m/rn) OVER (PARTITION BY date ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS q FROM
   (SELECT ticker, date, p_value, count(p_value) OVER (PARTITION BY date) AS m, row_number() OVER (PARTITION BY date ORDER BY p_value NULLS LAST) AS rn
    FROM (SELECT ticker, date, CASE WHEN ticker % 7 <> 0 THEN f4 END AS p_value FROM monthly)))"""


@q("i1_bh_fdr", _BH)
def _(s, d):
    return inf.bh_fdr(_bh_in(s, d), family=["date"])


@q("i1_bh_fdr_split", _BH)
def _(s, d):
    return inf.bh_fdr(_bh_in(s, d), family=["date"])


_ITC = ["interaction_beta", "t_stat", "p_value", "base_payoff", "q_value"]


@q("i2_interaction_tests", f"SELECT factor, macro_state, {r(*_ITC)}, n_periods, significant_fdr, n_tests_in_family FROM it")
def _(s, d):
    return inf.interaction_tests(b.score_rows(s, d), b.panel_states(s, d))


@q("i3_payoff_persistence", f"SELECT factor, lag, {r('beta', 't_stat', 'p_value', 'q_value')}, n, significant_fdr, n_tests_in_family, classification FROM pe")
def _(s, d):
    return inf.payoff_persistence(b.score_rows(s, d))


# --- windows ---------------------------------------------------------------------------------

@q("w1_pad_filled_return", f"SELECT ticker, i AS day_idx, {r('adj_close', 'filled', 'ret')} FROM ret_d")
def _(s, d):
    return cal.price_grid(b.daily(s, d), b.days(s, d)).select("ticker", "day_idx", "adj_close", "filled", "ret")


_W1O = "(SELECT ticker, date, CASE WHEN ticker % 9 = 0 THEN NULL WHEN ticker % 5 = 1 THEN 2 * adj_close ELSE adj_close END AS adj_close FROM daily)"
_W1G = f"""(SELECT t.ticker, c.i, s.adj_close, last_value(s.adj_close IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY c.i) AS filled
   FROM (SELECT DISTINCT ticker FROM daily) t CROSS JOIN cal_d c LEFT JOIN {_W1O} s ON s.ticker = t.ticker AND s.date = c.date)"""


@q("w1_repeats_and_empty", f"""SELECT ticker, i AS day_idx, {r('adj_close', 'filled')}, {r('filled / lag(filled) OVER (PARTITION BY ticker ORDER BY i) - 1 AS ret')} FROM {_W1G}""")
def _(s, d):
    """Entities without a single price, and rows that repeat a day, of which the last counts."""
    p = b.daily(s, d).withColumn("adj_close", F.when(F.col("ticker") % 9 != 0, F.col("adj_close"))).withColumn("seq", F.lit(0))
    p = p.unionByName(p.where("ticker % 5 = 1").withColumns({"adj_close": 2 * F.col("adj_close"), "seq": F.lit(1)}))
    return cal.price_grid(p, b.days(s, d), seq="seq").select("ticker", "day_idx", "adj_close", "filled", "ret")


_WZ = f"SELECT date, ticker, factor, {r('value', 'w')} FROM wz"


@q("w2_winsorise", _WZ)
def _(s, d):
    return rk.winsorize(b.long_panel(s, d), ["date", "factor"], "value", "w").select("date", "ticker", "factor", "value", "w")


@q("w2_winsorise_split", _WZ)
def _(s, d):
    return rk.winsorize(b.long_panel(s, d), ["date", "factor"], "value", "w").select(
        "date", "ticker", "factor", "value", "w")


_PR = f"SELECT date, ticker, factor, {r(pct('date, factor', 'value') + ' AS pct_rank')} FROM lp"


@q("w3_pct_rank", _PR)
def _(s, d):
    return rk.pct_rank(b.long_panel(s, d), ["date", "factor"], "value").select("date", "ticker", "factor", "pct_rank")


@q("w3_pct_rank_split", _PR)
def _(s, d):
    return rk.pct_rank(b.long_panel(s, d), ["date", "factor"], "value").select(
        "date", "ticker", "factor", "pct_rank")


@q("w4_rank_factors", f"SELECT date, ticker, factor, {r('w', 'rank')} FROM rk")
def _(s, d):
    return b.ranked(s, d).select("date", "ticker", "factor", "w", "rank")


@q("w4_rank_sector_neutral", f"SELECT date, ticker, factor, sector, {r('rank')} FROM rks")
def _(s, d):
    return rk.rank_factors(b.long_panel(s, d), sector="sector").select("date", "ticker", "factor", "sector", "rank")


@q("w5_expanding_z", f"SELECT date, {r('vix_z', 'credit_spread_z')} FROM ms")
def _(s, d):
    m = ft.expanding_z(b.macro(s, d), "vix", "vix_z")
    return ft.expanding_z(m, "credit_spread", "credit_spread_z").select("date", "vix_z", "credit_spread_z")


@q("w6_step_difference", f"SELECT date, {r('rate_10y_chg_3m')} FROM ms")
def _(s, d):
    return ft.step_diff(b.macro(s, d), "rate_10y", "rate_10y_chg_3m", 3).select("date", "rate_10y_chg_3m")


@q("w7_pad_filled_change", f"SELECT date, {r('wti_chg_6m', 'bench_trend_6m')} FROM ms")
def _(s, d):
    m = ft.pad_change(b.macro(s, d), "wti_oil", steps=6, out="wti_chg_6m")
    return ft.pad_change(m, "benchmark_adj_close", steps=6, out="bench_trend_6m").select("date", "wti_chg_6m", "bench_trend_6m")


@q("w8_macro_states", f"SELECT date, {r(*STATES)} FROM ms")
def _(s, d):
    return b.states(s, d)


def _price_panel(s, d):
    """All price look-backs on the monthly calendar: 6/6/12 steps back, 3 ahead."""
    p, days = b.monthly(s, d), b.month_ends(s, d)
    return ft.price_features(p, days, cal.rebalance_dates(days, "Q", 12, 3), ft.benchmark_on_calendar(days, b.macro(s, d)),
                             6, 6, 12, 3, 12)


@q("w9_momentum", f"SELECT date, ticker, {r('momentum_6m')} FROM pfm")
def _(s, d):
    return _price_panel(s, d).select("date", "ticker", "momentum_6m")


def _daily_panel(s, d):
    p, days = b.daily(s, d), b.days(s, d)
    return ft.price_features(p, days, cal.rebalance_dates(days), ft.benchmark_on_calendar(days, b.macro(s, d)))


@q("w10_low_volatility", f"SELECT x.date, ticker, {r('-sd * sqrt(252) AS low_volatility')} FROM roll_d g JOIN reb_d x ON x.i = g.i")
def _(s, d):
    return _daily_panel(s, d).select("date", "ticker", "low_volatility")


@q("w11_low_beta", f"SELECT x.date, ticker, {r('CASE WHEN bvar > 0 THEN -cv / bvar END AS low_beta')} FROM roll_d g JOIN reb_d x ON x.i = g.i JOIN bvar_d v ON v.i = x.i")
def _(s, d):
    return _daily_panel(s, d).select("date", "ticker", "low_beta")


@q("w12_forward_returns", f"SELECT date, ticker, {r('forward_return', 'forward_excess_return', 'benchmark_forward_return')} FROM pfm")
def _(s, d):
    return _price_panel(s, d).select("date", "ticker", "forward_return", "forward_excess_return", "benchmark_forward_return")


@q("w13_price_features", f"SELECT date, ticker, {r('momentum_6m', 'low_volatility', 'low_beta', 'forward_return', 'forward_excess_return', 'benchmark_forward_return')} FROM pfm")
def _(s, d):
    return _price_panel(s, d)


@q("w14_monthly_returns", f"SELECT ticker, {r('adj_close', 'filled', 'ret')}, mi - 1 AS month_no FROM mret")
def _(s, d):
    return ft.monthly_returns(b.daily(s, d), b.days(s, d))


for _name, _cols in {"w15_rolling_mean": ["rolling_ic", "rolling_spread"], "w16_rolling_se": ["rolling_ic_se"],
                     "w17_rolling_t": ["rolling_ic_t"], "w18_hit_rate": ["hit_rate"],
                     "w19_strengthening": ["strengthening_1p", "strengthening_4p"]}.items():
    @q(_name, f"SELECT date, factor, {r(*_cols)} FROM ro")
    def _(s, d, _cols=tuple(_cols)):
        return b.rolled(s, d).select("date", "factor", *_cols)


@q("w20_theme_z", f"SELECT date, priority, {r('priority_z')} FROM ps")
def _(s, d):
    return b.theme_scores(s, d).select("date", "priority", "priority_z")


@q("w21_yoy_growth", f"""SELECT ticker, date, {r('f / nullif(lag(f, 4) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS growth')} FROM
   (SELECT ticker, date, last_value(v IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS f
    FROM (SELECT ticker, date, CASE WHEN month(date) <> 9 THEN revenue_growth END AS v FROM fund))""")
def _(s, d):
    f = b.fundamentals(s, d).select("ticker", "date", F.when(F.month("date") != 9, F.col("revenue_growth")).alias("v"))
    return ft.yoy_growth(f, "v", "growth").select("ticker", "date", "growth")


@q("w22_index_to_yoy", f"SELECT date, {r('(cpi_yoy / nullif(lag(cpi_yoy, 12) OVER (ORDER BY date), 0) - 1) * 100 AS yoy')} FROM macro")
def _(s, d):
    return ft.pad_change(b.macro(s, d), "cpi_yoy", steps=12, out="yoy", scale=100.0).select("date", "yoy")


@q("w23_reporting_gap", "SELECT ticker, date, date_diff('day', lag(date) OVER (PARTITION BY ticker ORDER BY date), date) AS gap_days FROM fund")
def _(s, d):
    return ql.reporting_gaps(b.fundamentals(s, d).select("ticker", "date"))


# --- order, top-k, set operations ------------------------------------------------------------

@q("k1_themes_in_order", _PS + " ORDER BY date, priority_score DESC")
def _(s, d):
    return b.theme_scores(s, d).orderBy("date", F.col("priority_score").desc())


def _latest_ranks(where):
    slots = ", ".join(r(f"(SELECT theme_rank FROM tr WHERE tr.date = c.date AND tr.ticker = c.ticker AND tr.priority = '{t}' AND tr.priority IN (SELECT priority FROM tw WHERE tw.date = c.date)) AS score__{t.lower().replace(' ', '_')}")
                      for t in _THN)
    return f"""SELECT ticker, {r('composite_score')}, {slots}, row_number() OVER (ORDER BY composite_score DESC, ticker) AS rank, date AS as_of_date
        FROM cs c WHERE {where} ORDER BY rank LIMIT 20"""


@q("k2_top_entities_as_of", _latest_ranks(f"date = DATE '{b.AS_OF}'"))
def _(s, d):
    ranks = b.ranked(s, d)
    return pf.composite_ranks(ranks, b.theme_scores(s, d, ranks), b.theme_map(s), 20, b.AS_OF, theme_names=_THN)


@q("k2_top_entities_latest", _latest_ranks("date = (SELECT max(date) FROM panel)"))
def _(s, d):
    ranks = b.ranked(s, d)
    return pf.composite_ranks(ranks, b.theme_scores(s, d, ranks), b.theme_map(s), 20, theme_names=_THN)


@q("k2_unscored_day_is_empty", "SELECT ticker, composite_score FROM cs WHERE false")
def _(s, d):
    ranks = b.ranked(s, d)
    return pf.composite_ranks(ranks, b.theme_scores(s, d, ranks), b.theme_map(s), 20, "1971-01-01",
                              theme_names=_THN).select("ticker", "composite_score")


@q("k3_tests_by_q", f"SELECT factor, macro_state, {r('q_value')} FROM it ORDER BY q_value, factor, macro_state")
def _(s, d):
    return inf.order_by_q(inf.interaction_tests(b.score_rows(s, d), b.panel_states(s, d))).select("factor", "macro_state", "q_value")


@q("k4_persistence_in_order", f"SELECT factor, lag, {r('beta')} FROM pe ORDER BY factor, lag")
def _(s, d):
    return inf.payoff_persistence(b.score_rows(s, d)).select("factor", "lag", "beta").orderBy("factor", "lag")


@q("k5_all_tests", f"SELECT factor, macro_state, {r('interaction_beta', 't_stat', 'p_value', 'q_value')}, significant_fdr, n_periods FROM it")
def _(s, d):
    return rp.all_tests(inf.interaction_tests(b.score_rows(s, d), b.panel_states(s, d)))


_LAST = "ro WHERE date = (SELECT max(date) FROM ro)"


@q("k6_latest_by_t", f"SELECT factor, {r('rolling_ic', 'rolling_ic_se', 'rolling_ic_t', 'hit_rate', 'strengthening_4p')} FROM {_LAST}")
def _(s, d):
    return rp.latest_by_t(b.rolled(s, d))


@q("k7_walk_forward_listing", _WF + " ORDER BY date")
def _(s, d):
    return _wf(s, d).orderBy("date")


@q("u1_union_all", """SELECT 'prices' AS source, ticker, date FROM daily UNION ALL SELECT 'fundamentals', ticker, date FROM fund""")
def _(s, d):
    p = b.daily(s, d).select(F.lit("prices").alias("source"), "ticker", "date")
    return p.unionByName(b.fundamentals(s, d).select(F.lit("fundamentals").alias("source"), "ticker", "date"))


@q("u2_difference", f"SELECT ticker, 'prices' AS only_in FROM ({_PX_T} EXCEPT {_FD_T}) UNION ALL SELECT ticker, 'fundamentals' FROM ({_FD_T} EXCEPT {_PX_T})")
def _(s, d):
    p, f = (x.select("ticker").distinct() for x in _two_inputs(s, d))
    return p.join(f, "ticker", "left_anti").withColumn("only_in", F.lit("prices")).unionByName(
        f.join(p, "ticker", "left_anti").withColumn("only_in", F.lit("fundamentals")))


@q("u3_intersection", f"SELECT ticker FROM ({_PX_T} INTERSECT {_FD_T})")
def _(s, d):
    p, f = (x.select("ticker") for x in _two_inputs(s, d))
    return p.intersect(f)


@q("u4_member_sets", """SELECT a.priority AS a, z.priority AS b, (SELECT count(*) FROM tm x JOIN tm y USING (factor) WHERE x.priority = a.priority AND y.priority = z.priority
   AND factor IN (SELECT factor FROM rk WHERE rank IS NOT NULL)) AS n_shared FROM (SELECT DISTINCT priority FROM tm) a JOIN (SELECT DISTINCT priority FROM tm) z ON a.priority <= z.priority""")
def _(s, d):
    have = b.ranked(s, d).where("rank IS NOT NULL").select("factor").distinct()
    return th.shared_members(b.theme_map(s), have).where("a <= b")


@q("u5_states_by_date", f"SELECT date, {r(*STATES)} FROM pst")
def _(s, d):
    wide = ft.attach_macro(b.panel(s, d).select("date", "ticker"), b.states(s, d))
    return inf.states_by_date(wide, vocab.MACRO_STATES)


# --- report tables ---------------------------------------------------------------------------

@q("r1_current_themes", f"""SELECT row_number() OVER (ORDER BY priority_score DESC, priority) AS position, priority, {r('priority_score', 'priority_spread')},
   {_TREND.format('strengthening')} AS trend, n_members_scored || '/' || n_members_defined AS evidence,
   CASE row_number() OVER (ORDER BY priority_score DESC, priority) WHEN 1 THEN 'top' WHEN 2 THEN 'runner-up' ELSE '' END AS headline
   FROM ps WHERE date = (SELECT max(date) FROM ps)""")
def _(s, d):
    return rp.current_themes(b.theme_scores(s, d))


@q("r2_factor_evidence", f"SELECT factor, {r('rolling_ic', 'rolling_ic_se', 'rolling_ic_t', 'hit_rate')}, {_TREND.format('strengthening_4p')} AS trend FROM {_LAST}")
def _(s, d):
    return rp.factor_evidence(b.rolled(s, d))


@q("r3_persistence_table", f"SELECT factor, lag, {r('beta', 't_stat', 'q_value')}, n, CASE WHEN significant_fdr THEN 'significant' ELSE 'not significant' END || ' — ' || classification AS reading FROM pe")
def _(s, d):
    return rp.persistence_table(inf.payoff_persistence(b.score_rows(s, d)))


@q("r4_survivors", f"""SELECT factor, macro_state, {r('interaction_beta', 't_stat', 'q_value')}, n_periods, n_tests_in_family,
   CASE WHEN interaction_beta > 0 THEN 'higher' ELSE 'lower' END AS direction, CASE WHEN factor='f1' AND macro_state='credit_spread_z' THEN 'first wording'
   WHEN factor='mom' AND macro_state='vix_z' THEN 'second wording' ELSE 'mechanism not pre-mapped — interpret with care' END AS hint FROM {_IT95} WHERE significant_fdr""")
def _(s, d):
    return rp.survivors(_wide_fdr(s, d), _HINTS)


@q("r7_sensitivity_check", f"""SELECT x.factor || ' x ' || x.macro_state AS expected, CASE WHEN interaction_beta IS NULL THEN 'not run'
   WHEN interaction_beta > 0 AND significant_fdr THEN 'recovered' ELSE 'not recovered' END AS status, {r('interaction_beta AS estimate', 't_stat')}
   FROM {_EXPV} LEFT JOIN {_IT95} t ON t.factor = x.factor AND t.macro_state = x.macro_state
   UNION ALL SELECT factor, CASE WHEN rolling_ic > 0 AND rolling_ic_t > 1.5 THEN 'recovered' ELSE 'weak or not recovered' END, {r('rolling_ic AS estimate', 'rolling_ic_t AS t_stat')}
   FROM {_LAST} AND factor IN ('f2', 'mom')""")
def _(s, d):
    return rp.sensitivity_check(_wide_fdr(s, d), b.rolled(s, d), _expected(s), s.createDataFrame([("f2",), ("mom",)], "factor STRING"))


@q("r8_specificity_check", f"""SELECT (SELECT count(*) FROM it WHERE significant_fdr) AS n_survivors,
   (SELECT count(*) FROM {_LAST} AND abs(rolling_ic_t) > 2.5) AS n_large_t,
   CASE WHEN (SELECT count(*) FROM it WHERE significant_fdr) = 0 THEN 'PASSED' ELSE 'REVIEW NEEDED' END AS specificity""")
def _(s, d):
    return rp.specificity_check(inf.interaction_tests(b.score_rows(s, d), b.panel_states(s, d)), b.rolled(s, d))


# --- the whole run ---------------------------------------------------------------------------

FULL = research.Config(rebalance="Q", holding_months=3, steps_per_month=1, momentum=6, volatility=6, beta=12, lookback=12,
                       steps_per_year=12)
rel("x_tm", theme_values(vocab.THEMES))


def _full(s, d):
    return research.run(b.monthly(s, d).select("date", "ticker", "adj_close", "volume"), b.fundamentals(s, d), b.macro(s, d), FULL)


@q("full_run_factor_scores", f"SELECT date, factor, {r('ic', 'spread', 'payoff_slope')}, n_stocks, {r(*ROLLED)} FROM x_ro")
def _(s, d):
    return _full(s, d)["factor_scores"]


@q("full_run_priority_scores", on_full(_PS))
def _(s, d):
    return _full(s, d)["priority_scores"]


@q("full_run_interactions", on_full(f"SELECT factor, macro_state, {r(*_ITC)}, n_periods, significant_fdr, n_tests_in_family FROM it"))
def _(s, d):
    return _full(s, d)["interaction_tests"]


@q("full_run_persistence", on_full(f"SELECT factor, lag, {r('beta', 't_stat', 'p_value', 'q_value')}, n, significant_fdr, n_tests_in_family, classification FROM pe"))
def _(s, d):
    return _full(s, d)["factor_persistence"]


@q("full_run_stock_ranks", on_full(f"SELECT ticker, {r('composite_score')}, row_number() OVER (ORDER BY composite_score DESC, ticker) AS rank, date AS as_of_date FROM cs WHERE date = (SELECT max(date) FROM panel) ORDER BY rank LIMIT 20"))
def _(s, d):
    return _full(s, d)["latest_stock_ranks"].select("ticker", "composite_score", "rank", "as_of_date")


@q("full_run_walk_forward", on_full(_WF))
def _(s, d):
    return _full(s, d)["walk_forward_results"]
