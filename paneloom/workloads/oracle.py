"""DuckDB SQL written apart from the Spark plans: named relations and a composer that
prepends the ones a query needs."""

import re

REL = {}


def rel(name, sql):
    REL[name] = sql.strip()


def sql(final: str) -> str:
    need, order = set(), []

    def visit(text):
        for w in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text):
            if w in REL and w not in need:
                need.add(w)
                visit(REL[w])
                order.append(w)

    visit(final)
    head = ",\n".join(f"{n} AS ({REL[n]})" for n in order)
    return (f"WITH {head}\n" if head else "") + final.strip()


def r(*cols, digits=6) -> str:
    """Rounded select items without negative zero; 'expr AS name' or a plain column."""
    items = []
    for c in cols:
        e, _, n = c.rpartition(" AS ")
        e = e or n
        items.append(f"CASE WHEN round({e},{digits})=0 THEN CAST(0 AS DOUBLE) ELSE round({e},{digits}) END AS {n}")
    return ", ".join(items)


PRICE = ("CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS DOUBLE)/"
         "CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE)")
N = "CAST(count(*) AS DOUBLE)"


def share(cond):
    return f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS DOUBLE)/{N}"


rel("lines", "SELECT *, CAST(l_shipdate AS DATE) AS ship FROM lineitem")
rel("daily", f"""SELECT l_suppkey AS ticker, ship AS date, {PRICE} AS adj_close,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS volume FROM lines GROUP BY 1,2""")
rel("monthly", f"""SELECT l_suppkey AS ticker, last_day(ship) AS date, {PRICE} AS adj_close,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS volume,
    CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS DOUBLE)/{N} AS f1,
    CASE WHEN l_suppkey % 7 <> 0 THEN CAST(sum(CAST(round(l_tax*100) AS BIGINT)) AS DOUBLE)/{N} END AS f2,
    {share("l_returnflag='R'")} AS f4 FROM lines GROUP BY 1,2""")
rel("sectors", """SELECT s_suppkey AS ticker, CASE WHEN s_suppkey % 11 <> 0 THEN 'R' || n_regionkey END AS sector
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
rel("fund", f"""SELECT b.*, sector FROM (SELECT l_suppkey AS ticker,
    last_day(CAST(date_trunc('quarter', ship) + INTERVAL 2 MONTH AS DATE)) AS date,
    CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS DOUBLE)/{N} AS fcf_yield,
    CAST(sum(CAST(round(l_tax*100) AS BIGINT)) AS DOUBLE)/{N} AS debt_to_equity,
    CASE WHEN l_suppkey % 7 <> 0 THEN {share("l_returnflag='R'")} END AS roe,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS revenue_growth,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE)/{N} - CAST(22 AS DOUBLE) AS pe,
    CAST(sum(l_linenumber) AS DOUBLE)/{N} - CAST(3.5 AS DOUBLE) AS ev_ebitda,
    {share("l_linestatus='F'")} AS dividend_yield, {N} AS shares_dilution
    FROM lines GROUP BY 1,2) b LEFT JOIN sectors USING (ticker)""")
rel("macro", f"""SELECT date, CASE WHEN month(date)<>11 THEN b END AS benchmark_adj_close, rate_10y, rate_2y,
    cpi_yoy, CASE WHEN month(date)<>3 THEN o END AS wti_oil, CASE WHEN month(date)<>7 THEN v END AS vix, credit_spread
    FROM (SELECT last_day(CAST(o_orderdate AS DATE)) AS date,
      CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS DOUBLE)/{N} AS b,
      ({share("o_orderpriority LIKE '1-%'")})*CAST(10 AS DOUBLE) AS rate_10y,
      ({share("o_orderstatus='F'")})*CAST(10 AS DOUBLE) AS rate_2y,
      CAST(sum(o_orderkey % 7) AS DOUBLE)/{N} AS cpi_yoy,
      CAST(sum(CASE WHEN o_orderstatus='O' THEN CAST(round(o_totalprice*100) AS BIGINT) END) AS DOUBLE)
        / CAST(count(CASE WHEN o_orderstatus='O' THEN 1 END) AS DOUBLE) AS o,
      CAST(sum(o_custkey % 100) AS DOUBLE)/{N} AS v, {share("o_orderpriority LIKE '5-%'")} AS credit_spread
      FROM orders GROUP BY 1)""")
rel("univ", "SELECT s_suppkey AS ticker FROM supplier WHERE s_acctbal > 0")
rel("mstore", f"""SELECT 'series_' || lower(o_orderstatus) AS series_name, last_day(CAST(o_orderdate AS DATE)) AS observation_date,
    o_orderpriority AS provider, CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS DOUBLE)/{N} AS value,
    max(o_orderdate) AS retrieved_at FROM orders GROUP BY 1,2,3""")

# calendars
for tag, src in (("d", "daily"), ("m", "monthly")):
    rel(f"cal_{tag}", f"""SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n
        FROM (SELECT DISTINCT date FROM {src})""")
rel("reb_d", """SELECT max(date) AS date, max(i) AS i FROM cal_d GROUP BY date_trunc('quarter', date)
    HAVING max(i) >= 252 AND max(i) + 63 < max(n)""")
rel("reb_m", """SELECT max(date) AS date, max(i) AS i FROM cal_m GROUP BY date_trunc('quarter', date)
    HAVING max(i) >= 12 AND max(i) + 3 < max(n)""")

# monthly panel
rel("panel0", """SELECT m.*, year(date)*12+month(date) AS mi FROM monthly m""")
rel("panel", """SELECT a.date, a.ticker, sector, a.adj_close, a.f1, a.f2, a.f4,
    a.adj_close / b.adj_close - 1 AS mom, c.adj_close / a.adj_close - 1 AS y
    FROM panel0 a LEFT JOIN panel0 b ON b.ticker = a.ticker AND b.mi = a.mi - 6
    LEFT JOIN panel0 c ON c.ticker = a.ticker AND c.mi = a.mi + 1
    LEFT JOIN sectors s ON s.ticker = a.ticker""")
rel("lp", " UNION ALL ".join(f"SELECT date, ticker, sector, y, '{f}' AS factor, {f} AS value FROM panel"
                              for f in ("f1", "f2", "f4", "mom")))
rel("lp_pos", """SELECT *, row_number() OVER (PARTITION BY date, factor ORDER BY value) - 1 AS k,
    count(*) OVER (PARTITION BY date, factor) AS n FROM lp WHERE value IS NOT NULL""")
rel("lp_q", """SELECT date, factor, max(n) AS n,
    max(CASE WHEN k = floor(CAST(0.01 AS DOUBLE)*(n-1)) THEN value END) AS l0, max(CASE WHEN k = ceil(CAST(0.01 AS DOUBLE)*(n-1)) THEN value END) AS l1,
    max(CAST(0.01 AS DOUBLE)*(n-1) - floor(CAST(0.01 AS DOUBLE)*(n-1))) AS lf,
    max(CASE WHEN k = floor(CAST(0.99 AS DOUBLE)*(n-1)) THEN value END) AS h0, max(CASE WHEN k = ceil(CAST(0.99 AS DOUBLE)*(n-1)) THEN value END) AS h1,
    max(CAST(0.99 AS DOUBLE)*(n-1) - floor(CAST(0.99 AS DOUBLE)*(n-1))) AS hf FROM lp_pos GROUP BY 1,2""")
rel("wz", """SELECT lp.*, CASE WHEN value IS NULL THEN NULL WHEN q.n < 5 THEN value
    ELSE greatest(l0+(l1-l0)*lf, least(h0+(h1-h0)*hf, value)) END AS w FROM lp LEFT JOIN lp_q q USING (date, factor)""")


def pct(keys, v):
    return (f"CASE WHEN {v} IS NOT NULL THEN (rank() OVER (PARTITION BY {keys} ORDER BY {v} NULLS LAST) + "
            f"(count(*) OVER (PARTITION BY {keys}, {v}) - 1) / CAST(2 AS DOUBLE)) / count({v}) OVER (PARTITION BY {keys}) END")


def avg_rank(keys, v):
    return (f"(rank() OVER (PARTITION BY {keys} ORDER BY {v}) + "
            f"(count(*) OVER (PARTITION BY {keys}, {v}) - 1) / CAST(2 AS DOUBLE))")


rel("rk", f"SELECT *, {pct('date, factor', 'w')} AS rank FROM wz")
rel("rks", f"""SELECT * REPLACE (CASE WHEN sector IS NOT NULL THEN rank END AS rank) FROM
    (SELECT *, {pct('date, factor, sector', 'w')} AS rank FROM wz)""")
rel("pairs", f"""SELECT *, {avg_rank('date, factor', 'rank')} AS rx, {avg_rank('date, factor', 'y')} AS ry,
    count(*) OVER (PARTITION BY date, factor) AS n FROM rk WHERE rank IS NOT NULL AND y IS NOT NULL""")


def corr(x, y):
    return f"covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0)"


rel("ics", f"SELECT date, factor, CASE WHEN count(*) >= 10 THEN {corr('rx', 'ry')} END AS ic, count(*) AS n FROM pairs GROUP BY 1,2")
rel("sps", """SELECT date, factor, CASE WHEN count(*) >= 15 THEN avg(CASE WHEN 5*rx >= 4*n THEN y END)
    - avg(CASE WHEN 5*rx <= n THEN y END) END AS spread FROM pairs GROUP BY 1,2""")
rel("sls", """SELECT date, factor, CASE WHEN nr >= 10 AND sd > 0 AND np >= 5 THEN b * sd END AS payoff_slope FROM
    (SELECT date, factor, count(rank) AS nr, stddev_samp(rank) AS sd,
     regr_slope(y, CASE WHEN y IS NOT NULL THEN rank END) AS b,
     count(CASE WHEN y IS NOT NULL THEN rank END) AS np FROM rk GROUP BY 1,2)""")
rel("sc", """SELECT d.date, d.factor, ic, spread, payoff_slope, coalesce(n, 0) AS n_stocks
    FROM (SELECT DISTINCT date, factor FROM lp) d LEFT JOIN ics USING (date, factor)
    LEFT JOIN sps USING (date, factor) LEFT JOIN sls USING (date, factor)""")

# rolling
W8 = "(PARTITION BY factor ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"
rel("ro0", f"""SELECT *, CASE WHEN count(ic) OVER {W8} >= 4 THEN avg(ic) OVER {W8} END AS rolling_ic,
    CASE WHEN count(ic) OVER {W8} >= 4 THEN stddev_samp(ic) OVER {W8} / sqrt(count(ic) OVER {W8}) END AS rolling_ic_se,
    CASE WHEN count(spread) OVER {W8} >= 4 THEN avg(spread) OVER {W8} END AS rolling_spread,
    CASE WHEN count(*) OVER {W8} >= 4 THEN avg(CAST(CASE WHEN ic > 0 THEN 1 ELSE 0 END AS DOUBLE)) OVER {W8} END AS hit_rate
    FROM sc""")
rel("ro", """SELECT *, rolling_ic / nullif(rolling_ic_se, 0) AS rolling_ic_t,
    rolling_ic - lag(rolling_ic, 1) OVER (PARTITION BY factor ORDER BY date) AS strengthening_1p,
    rolling_ic - lag(rolling_ic, 4) OVER (PARTITION BY factor ORDER BY date) AS strengthening_4p FROM ro0""")

# themes
rel("tm", """SELECT * FROM (VALUES ('Theme One','f1',2),('Theme One','f2',2),('Theme Two','f2',2),('Theme Two','f4',2),
    ('Theme Three','f1',2),('Theme Three','mom',2),('Theme Four','f4',3),('Theme Four','mom',3),
    ('Theme Four','absent_factor',3)) v(priority, factor, n_members_defined)""")
rel("ps0", """SELECT date, priority, avg(rolling_ic) AS priority_score, avg(rolling_spread) AS priority_spread,
    avg(strengthening_4p) AS strengthening, count(*) AS n_members_scored, max(n_members_defined) AS n_members_defined
    FROM ro JOIN tm USING (factor) WHERE rolling_ic IS NOT NULL GROUP BY 1,2""")
rel("ps", """SELECT *, CASE WHEN stddev_samp(priority_score) OVER (PARTITION BY date) > 0 THEN
    (priority_score - avg(priority_score) OVER (PARTITION BY date)) / stddev_samp(priority_score) OVER (PARTITION BY date)
    ELSE 0 END AS priority_z FROM ps0""")
rel("psd", "SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM ps)")
rel("tw0", """SELECT a.date, priority, greatest(avg(priority_score), 0) AS pos, bool_or(b.i = a.i) AS cur
    FROM psd a JOIN psd b ON b.i BETWEEN a.i - 3 AND a.i JOIN ps ON ps.date = b.date GROUP BY 1,2""")
rel("tw", """SELECT * FROM (SELECT date, priority, CASE WHEN sum(pos) OVER (PARTITION BY date) > 0
    THEN pos / sum(pos) OVER (PARTITION BY date)
    WHEN cur THEN CAST(1 AS DOUBLE) / count(CASE WHEN cur THEN 1 END) OVER (PARTITION BY date) END AS weight FROM tw0)
    WHERE weight IS NOT NULL""")
rel("tr", """SELECT date, ticker, priority, avg(rank) AS theme_rank FROM rk JOIN tm USING (factor) GROUP BY 1,2,3""")
rel("cs", """SELECT p.date, p.ticker, max(p.y) AS y, coalesce(sum(weight * theme_rank), 0) AS composite_score
    FROM panel p LEFT JOIN tr USING (date, ticker) LEFT JOIN tw ON tw.date = p.date AND tw.priority = tr.priority GROUP BY 1,2""")
rel("topn", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY composite_score DESC, ticker) AS rank
    FROM cs WHERE date IN (SELECT date FROM tw)) WHERE rank <= 20""")
rel("wf", """SELECT date, count(y) AS n_holdings, avg(y) AS portfolio_forward_excess_return, avg(y) > 0 AS hit
    FROM topn GROUP BY 1 HAVING count(y) > 0""")

# macro states
E8 = "(ORDER BY date ROWS UNBOUNDED PRECEDING)"


def ez(c):
    return (f"CASE WHEN count({c}) OVER {E8} >= 8 THEN ({c} - avg({c}) OVER {E8}) / "
            f"nullif(stddev_samp({c}) OVER {E8}, 0) END")


rel("mf", f"""SELECT *, rate_10y - rate_2y AS curve, last_value(benchmark_adj_close IGNORE NULLS) OVER {E8} AS bf,
    last_value(wti_oil IGNORE NULLS) OVER {E8} AS wf_oil FROM macro""")
rel("ms", f"""SELECT date, {ez('credit_spread')} AS credit_spread_z, {ez('rate_10y')} AS rate_10y_z,
    rate_10y - lag(rate_10y, 3) OVER (ORDER BY date) AS rate_10y_chg_3m, {ez('curve')} AS curve_z,
    {ez('cpi_yoy')} AS cpi_yoy_z, {ez('vix')} AS vix_z, bf / lag(bf, 6) OVER (ORDER BY date) - 1 AS bench_trend_6m,
    wf_oil / lag(wf_oil, 6) OVER (ORDER BY date) - 1 AS wti_chg_6m FROM mf""")
STATES = ["credit_spread_z", "rate_10y_z", "rate_10y_chg_3m", "curve_z", "cpi_yoy_z", "vix_z", "bench_trend_6m", "wti_chg_6m"]
rel("pst", """SELECT d.date, m.* EXCLUDE (date) FROM (SELECT DISTINCT date FROM panel) d
    ASOF LEFT JOIN ms m ON d.date >= m.date""")
rel("pstl", " UNION ALL ".join(f"SELECT date, '{s}' AS macro_state, {s} AS state FROM pst" for s in STATES))


def tp(t, v):
    """Two-sided Student-t p, series with gamma-function coefficients."""
    th = f"atan(abs({t})/sqrt({v}))"
    ev = (f"1 - sin({th})*list_sum(list_transform(range(0, CAST({v}//2 AS BIGINT)), lambda k: "
          f"exp(lgamma(k+0.5)-lgamma(0.5)-lgamma(k+1))*pow(cos({th}),2*k)))")
    od = (f"1 - (2/pi())*({th} + CASE WHEN {v} >= 3 THEN sin({th})*list_sum(list_transform(range(0, CAST(({v}-1)//2 AS BIGINT)), lambda k: "
          f"exp(lgamma(k+1)+lgamma(1.5)-lgamma(k+1.5))*pow(cos({th}),2*k+1))) ELSE 0 END)")
    return f"CASE WHEN {t} IS NULL THEN NULL WHEN {v} % 2 = 0 THEN greatest({ev}, 0) ELSE greatest({od}, 0) END"


def ols_rel(name, src, keys, x, y):
    """name0 holds moments, name the estimates."""
    rel(name + "_m", f"""SELECT {keys}, CAST(regr_count({y},{x}) AS BIGINT) AS n, regr_sxx({y},{x}) AS sxx, regr_syy({y},{x}) AS syy,
        regr_sxy({y},{x}) AS sxy, regr_avgx({y},{x}) AS mx, regr_avgy({y},{x}) AS my FROM {src} GROUP BY {keys}""")
    rel(name + "_b", f"""SELECT *, n - 2 AS dof, CASE WHEN n >= 5 AND sxx > 0 THEN sxy/sxx END AS beta FROM {name}_m""")
    rel(name + "_e", f"""SELECT *, my - beta*mx AS alpha, sqrt(greatest(syy - beta*sxy, 0)/dof/sxx) AS se,
        sqrt(greatest(syy - beta*sxy, 0)/dof*(1.0/n + mx*mx/sxx)) AS alpha_se FROM {name}_b WHERE beta IS NOT NULL
        UNION ALL SELECT *, NULL, NULL, NULL FROM {name}_b WHERE beta IS NULL""")
    rel(name + "_t", f"SELECT *, beta/nullif(se,0) AS t_stat, alpha/nullif(alpha_se,0) AS alpha_t FROM {name}_e")
    rel(name, f"SELECT *, {tp('t_stat', 'dof')} AS p_value, {tp('alpha_t', 'dof')} AS alpha_p FROM {name}_t")


def bh(src, p="p_value"):
    return (f"SELECT *, CASE WHEN {p} IS NOT NULL THEN least(CAST(1 AS DOUBLE), min({p}*m/rn) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW "
            f"AND UNBOUNDED FOLLOWING)) END AS q_value FROM (SELECT *, count({p}) OVER () AS m, "
            f"row_number() OVER (ORDER BY {p} NULLS LAST) AS rn FROM {src})")


rel("ip", """SELECT s.date, factor, macro_state, payoff_slope, state FROM sc s JOIN pstl USING (date)""")
rel("ip2", "SELECT * FROM ip WHERE payoff_slope IS NOT NULL AND state IS NOT NULL")
ols_rel("fit", "ip2", "factor, macro_state", "state", "payoff_slope")
rel("fit12", "SELECT * FROM fit WHERE n >= 12 AND beta IS NOT NULL")
rel("it", f"""SELECT factor, macro_state, beta AS interaction_beta, t_stat, p_value, n AS n_periods, alpha AS base_payoff,
    q_value, q_value <= 0.10 AS significant_fdr, count(*) OVER () AS n_tests_in_family FROM ({bh('fit12')})""")
rel("lagged", " UNION ALL ".join(
    f"SELECT factor, {k} AS lag, ic, lag(ic, {k}) OVER (PARTITION BY factor ORDER BY date) AS past FROM sc" for k in (1, 4)))
ols_rel("ar", "lagged", "factor, lag", "past", "ic")
rel("ar8", """SELECT factor, lag, CASE WHEN n >= 8 THEN beta END AS beta, CASE WHEN n >= 8 THEN t_stat END AS t_stat,
    CASE WHEN n >= 8 THEN p_value END AS p_value, n FROM ar""")
rel("pe", f"""SELECT factor, lag, beta, t_stat, p_value, n, q_value, coalesce(q_value <= 0.10, false) AS significant_fdr,
    count(*) OVER () AS n_tests_in_family,
    CASE WHEN beta IS NULL THEN 'inconclusive (insufficient history)'
    WHEN NOT coalesce(q_value <= 0.10, false) THEN 'inconclusive (not distinguishable from noise)'
    WHEN beta > 0 THEN 'persistent (momentum in payoff)' ELSE 'mean-reverting' END AS classification FROM ({bh('ar8')})""")

# price look-backs on the daily calendar (pad-filled returns) and on the monthly calendar
rel("seen_d", "SELECT ticker, i, adj_close FROM daily JOIN cal_d USING (date)")
rel("grid_d", """SELECT t.ticker, c.i, c.date, s.adj_close,
    last_value(s.adj_close IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY c.i) AS filled
    FROM (SELECT DISTINCT ticker FROM daily) t CROSS JOIN cal_d c LEFT JOIN seen_d s ON s.ticker = t.ticker AND s.i = c.i""")
rel("ret_d", """SELECT *, filled / lag(filled) OVER (PARTITION BY ticker ORDER BY i) - 1 AS ret FROM grid_d""")
rel("bench_d", """SELECT c.date, i, m.benchmark_adj_close AS bench FROM cal_d c ASOF LEFT JOIN macro m ON c.date >= m.date""")
rel("bret_d", """SELECT *, f / lag(f) OVER (ORDER BY i) - 1 AS bench_ret FROM
    (SELECT *, last_value(bench IGNORE NULLS) OVER (ORDER BY i) AS f FROM bench_d)""")
rel("bvar_d", "SELECT *, var_samp(bench_ret) OVER (ORDER BY i ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) AS bvar FROM bret_d")
rel("roll_d", """SELECT g.ticker, g.i, g.date,
    stddev_samp(ret) OVER (PARTITION BY ticker ORDER BY g.i ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING) AS sd,
    covar_samp(ret, bench_ret) OVER (PARTITION BY ticker ORDER BY g.i ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) AS cv
    FROM ret_d g JOIN bret_d b ON b.i = g.i""")
rel("seen_m", "SELECT ticker, i, adj_close FROM monthly JOIN cal_m USING (date)")
rel("grid_m", """SELECT t.ticker, c.i, c.date, s.adj_close,
    last_value(s.adj_close IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY c.i) AS filled
    FROM (SELECT DISTINCT ticker FROM monthly) t CROSS JOIN cal_m c LEFT JOIN seen_m s ON s.ticker = t.ticker AND s.i = c.i""")
rel("ret_m", """SELECT *, filled / lag(filled) OVER (PARTITION BY ticker ORDER BY i) - 1 AS ret FROM grid_m""")
rel("bench_m", """SELECT c.date, i, m.benchmark_adj_close AS bench FROM cal_m c ASOF LEFT JOIN macro m ON c.date >= m.date""")
rel("bret_m", """SELECT *, f / lag(f) OVER (ORDER BY i) - 1 AS bench_ret FROM
    (SELECT *, last_value(bench IGNORE NULLS) OVER (ORDER BY i) AS f FROM bench_m)""")
rel("bvar_m", "SELECT *, var_samp(bench_ret) OVER (ORDER BY i ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS bvar FROM bret_m")
rel("roll_m", """SELECT g.ticker, g.i, g.date, g.adj_close AS p0,
    lag(g.adj_close, 6) OVER (PARTITION BY ticker ORDER BY g.i) AS pb, lead(g.adj_close, 3) OVER (PARTITION BY ticker ORDER BY g.i) AS pf,
    stddev_samp(ret) OVER (PARTITION BY ticker ORDER BY g.i ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS sd,
    covar_samp(ret, bench_ret) OVER (PARTITION BY ticker ORDER BY g.i ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS cv
    FROM ret_m g JOIN bret_m b ON b.i = g.i""")
rel("pfm", """SELECT r.date, p.ticker, p0 / pb - 1 AS momentum_6m, -sd * sqrt(12) AS low_volatility,
    CASE WHEN v.bvar > 0 THEN -cv / v.bvar END AS low_beta, pf / p0 - 1 AS forward_return,
    pf / p0 - 1 - (f.bench / v.bench - 1) AS forward_excess_return, f.bench / v.bench - 1 AS benchmark_forward_return
    FROM reb_m r JOIN roll_m p ON p.i = r.i JOIN bvar_m v ON v.i = r.i JOIN bench_m f ON f.i = r.i + 3""")

# monthly returns against a monthly series
rel("months", """SELECT unnest(range((SELECT CAST(min(year(date)*12+month(date)) AS BIGINT) FROM daily),
    (SELECT CAST(max(year(date)*12+month(date))+1 AS BIGINT) FROM daily))) AS mi""")
rel("mpx", """SELECT ticker, year(date)*12+month(date) AS mi, arg_max(adj_close, date) AS px FROM daily GROUP BY 1,2""")
rel("mgrid", """SELECT t.ticker, mo.mi, m.px AS adj_close, last_value(m.px IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY mo.mi) AS filled
    FROM (SELECT DISTINCT ticker FROM daily) t CROSS JOIN months mo LEFT JOIN mpx m ON m.ticker = t.ticker AND m.mi = mo.mi""")
rel("mret", "SELECT *, filled / lag(filled) OVER (PARTITION BY ticker ORDER BY mi) - 1 AS ret FROM mgrid")
rel("wchg", f"""SELECT date, year(date)*12+month(date) AS mi, wf_oil / lag(wf_oil) OVER (ORDER BY date) - 1 AS chg FROM mf""")
for tag in "dm":
    rel(f"cw_{tag}", f"""SELECT r.date, mo.mi, chg FROM (SELECT date, CASE WHEN date = last_day(date) THEN year(date)*12+month(date)
        ELSE year(date)*12+month(date)-1 END AS e FROM reb_{tag}) r JOIN months mo ON mo.mi BETWEEN e - 11 AND e LEFT JOIN wchg USING (mi)""")
    rel(f"cwok_{tag}", f"SELECT date FROM cw_{tag} GROUP BY 1 HAVING count(*) >= 10 AND count(chg) >= 10")
    rel(f"cs_{tag}", f"""SELECT w.date, ticker, {corr("CASE WHEN chg IS NOT NULL THEN ret END", "CASE WHEN ret IS NOT NULL THEN chg END")}
        AS commodity_sensitivity FROM cw_{tag} w JOIN mret USING (mi) WHERE w.date IN (SELECT date FROM cwok_{tag}) GROUP BY 1,2""")

# attributes
rel("fund2", """SELECT *, -debt_to_equity AS debt_to_equity_inv, CASE WHEN pe > 0 THEN 1/pe END AS earnings_yield,
    CASE WHEN ev_ebitda > 0 THEN 1/ev_ebitda END AS ev_ebitda_inv, -shares_dilution AS shares_dilution_inv FROM fund""")

# --- the whole run on the monthly binding: catalogue factors and themes -----------------------
CHAIN = ["lp", "lp_pos", "lp_q", "wz", "rk", "pairs", "ics", "sps", "sls", "sc", "ro0", "ro", "tm", "ps0", "ps", "psd",
         "tw0", "tw", "tr", "cs", "topn", "wf", "panel", "pst", "pstl", "ip", "ip2", "fit", "fit_m", "fit_b", "fit_e",
         "fit_t", "fit12", "it", "lagged", "ar", "ar_m", "ar_b", "ar_e", "ar_t", "ar8", "pe"]
_PAT = re.compile(r"\b(" + "|".join(sorted(CHAIN, key=len, reverse=True)) + r")\b")


def on_full(text):
    """The same relation over the full-run panel."""
    return _PAT.sub(r"x_\1", text)


for _n in CHAIN:
    rel("x_" + _n, on_full(REL[_n]))
rel("mpx_f", "SELECT ticker, year(date)*12+month(date) AS mi, adj_close AS px FROM monthly")
rel("mgrid_f", REL["mgrid"].replace("mpx", "mpx_f").replace("FROM daily", "FROM monthly"))
rel("mret_f", REL["mret"].replace("mgrid", "mgrid_f"))
rel("cs_f", REL["cs_m"].replace("mret", "mret_f"))
rel("x_panel", """SELECT p.*, p.forward_excess_return AS y, commodity_sensitivity, f.fcf_yield, f.debt_to_equity_inv, f.roe, f.revenue_growth,
    f.shares_dilution_inv, f.earnings_yield, f.ev_ebitda_inv, f.dividend_yield
    FROM (SELECT *, CAST(date - INTERVAL 60 DAY AS DATE) AS cut FROM pfm) p
    LEFT JOIN cs_f c ON c.date = p.date AND c.ticker = p.ticker ASOF LEFT JOIN fund2 f ON f.ticker = p.ticker AND p.cut >= f.date""")
FULL_FACTORS = ["fcf_yield", "debt_to_equity_inv", "roe", "revenue_growth", "shares_dilution_inv", "earnings_yield", "ev_ebitda_inv",
                "dividend_yield", "momentum_6m", "low_volatility", "low_beta", "commodity_sensitivity"]
rel("x_lp0", " UNION ALL ".join(f"SELECT date, ticker, y, '{f}' AS factor, {f} AS value FROM x_panel" for f in FULL_FACTORS))
rel("x_lp", """SELECT * FROM x_lp0 WHERE factor IN (SELECT factor FROM x_lp0 GROUP BY 1 HAVING CAST(count(value) AS DOUBLE)/count(*) >= 0.4)""")


def theme_values(themes):
    rows = ",".join(f"('{t}','{f}',{len(fs)})" for t, fs in themes.items() for f in fs)
    return f"SELECT * FROM (VALUES {rows}) v(priority, factor, n_members_defined)"
