"""The analysis run: three input tables in, all result tables out. Inputs are checked while they are written."""

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, functions as F

from paneloom import vocab
from paneloom.operators import (asof, quality, calendar as cal, features, inference, portfolio, ranking,
                                rolling, scores, themes as th)
from paneloom.session import cut_lineage


@dataclass
class Config:
    rebalance: str = "Q"
    holding_months: int = 3
    rolling_windows: int = 8
    top_n: int = 20
    weight_smoothing_periods: int = 4
    fundamental_lag_days: int = 60
    sector_neutral: bool = False
    fdr: float = 0.10
    min_coverage: float = 0.4
    # calendar-index steps; the defaults suit a daily calendar
    steps_per_month: int = 21
    momentum: int = 126
    volatility: int = 126
    beta: int = 252
    lookback: int = 252
    steps_per_year: int = 252

    @property
    def holding(self):
        return self.holding_months * self.steps_per_month

    def as_dict(self):
        return asdict(self)


def build_panel(prices: DataFrame, fundamentals: DataFrame, macro: DataFrame, cfg: Config = Config(),
                seq=None, keep=lambda df: df) -> DataFrame:
    """One row per (rebalance date, ticker): look-backs, forward excess return, as-of attributes,
    macro states. `keep` is applied to the calendar, which is read in many places."""
    days = keep(cal.trading_calendar(prices))
    bench = (features.benchmark_on_calendar(days, macro) if "benchmark_adj_close" in macro.columns
             else cal.equal_weight_benchmark(prices))
    rdates = cal.rebalance_dates(days, cfg.rebalance, cfg.lookback, cfg.holding)
    panel = features.price_features(prices, days, rdates, bench, cfg.momentum, cfg.volatility, cfg.beta,
                                    cfg.holding, cfg.steps_per_year)
    if "wti_oil" in macro.columns:
        panel = panel.join(features.commodity_sensitivity(prices, days, rdates, macro), ["date", "ticker"], "left")
    panel = asof.fundamentals_asof(panel, features.derive_factors(fundamentals), cfg.fundamental_lag_days, seq=seq)
    return features.attach_macro(panel, features.macro_states(macro))


def run(prices: DataFrame, fundamentals: DataFrame, macro: DataFrame, cfg: Config = Config(),
        theme_map=None, seq=None, cut=True) -> dict:
    """All result tables. The calendar, the panel, the ranks and the scores each feed several
    results, so each is written once to the shared checkpoint folder and read back; so are the inputs, which
    are checked on the way (cut=False keeps everything lazy and checks nothing)."""
    keep = cut_lineage if cut else (lambda df: df)
    spark = prices.sparkSession
    given, audits, issues = {"prices": prices, "fundamentals": fundamentals, "macro": macro}, None, None
    if cut:
        for name, df in given.items():
            given[name], a, i = quality.load_checked(df, name, seq if seq in df.columns else None)
            audits, issues = (a, i) if audits is None else (audits.unionByName(a), issues.unionByName(i))
        prices, fundamentals, macro = given.values()
    panel = keep(build_panel(prices, fundamentals, macro, cfg, seq, keep))
    states = inference.states_by_date(panel, vocab.MACRO_STATES)
    sector = ["sector"] if cfg.sector_neutral and "sector" in panel.columns else []
    by = (sector or [None])[0]
    long = ranking.covered_long(panel, vocab.FACTORS, ["date", "ticker", "forward_excess_return", *sector], by, cfg.min_coverage)
    ranked = keep(ranking.rank_factors(long, sector=by))
    themes = th.theme_table(spark, theme_map)
    fscores = keep(scores.score_factors(ranked))
    rolled = rolling.add_rolling_stats(fscores, cfg.rolling_windows)
    pscores = keep(th.score_themes(rolled, themes))
    wf = portfolio.walk_forward(ranked, pscores, themes, cfg.top_n, cfg.weight_smoothing_periods)
    checked = {"input_audit": audits, "input_issues": issues} if cut else {}
    return {
        **checked,
        "panel_rebalance_data": panel,
        "factor_ranks": ranked,
        "factor_scores": rolled,
        "factor_persistence": inference.payoff_persistence(fscores, fdr=cfg.fdr),
        "priority_scores": pscores,
        "theme_overlap": th.theme_overlap(themes, ranked.select("factor").distinct()),
        "interaction_tests": inference.interaction_tests(fscores, states, fdr=cfg.fdr),
        "theme_weights": th.theme_weights(pscores, cfg.weight_smoothing_periods),
        "latest_stock_ranks": portfolio.composite_ranks(
            ranked, pscores, themes, cfg.top_n, smoothing=cfg.weight_smoothing_periods,
            theme_names=list(theme_map or vocab.THEMES)),
        "walk_forward_results": wf,
        "walk_forward_summary": portfolio.walk_forward_summary(wf),
    }


def as_of(rolled: DataFrame) -> DataFrame:
    return rolled.agg(F.max("date").alias("as_of_date"))
