"""Default vocabulary: factor, macro-state and theme names used when the caller gives none.

All operators take these as arguments; nothing below is hard-wired into a plan.
"""

# The 17 catalogue factors, in catalogue order.
FACTORS = [
    "fcf_yield", "free_cash_flow_margin", "operating_margin", "gross_margin",
    "debt_to_equity_inv", "interest_coverage", "roe", "revenue_growth",
    "eps_revision", "shares_dilution_inv", "earnings_yield", "ev_ebitda_inv",
    "dividend_yield", "momentum_6m", "low_volatility", "low_beta",
    "commodity_sensitivity",
]

# The 8 macro states.
MACRO_STATES = [
    "credit_spread_z", "rate_10y_z", "rate_10y_chg_3m", "curve_z",
    "cpi_yoy_z", "vix_z", "bench_trend_6m", "wti_chg_6m",
]

# Themes and their member factors.
THEMES = {
    "Cash generation": ["fcf_yield", "free_cash_flow_margin", "operating_margin"],
    "Balance sheet strength": ["debt_to_equity_inv", "interest_coverage", "fcf_yield"],
    "Growth scarcity": ["revenue_growth", "eps_revision", "momentum_6m", "roe"],
    "Valuation discipline": ["earnings_yield", "ev_ebitda_inv", "fcf_yield"],
    "Risk avoidance": ["low_volatility", "low_beta", "debt_to_equity_inv", "dividend_yield"],
    "Inflation protection": ["gross_margin", "operating_margin", "revenue_growth",
                             "commodity_sensitivity"],
    "Capital discipline": ["fcf_yield", "shares_dilution_inv", "roe"],
}

# Required and optional columns of the three inputs.
REQUIRED = {
    "prices": ["date", "ticker", "adj_close", "volume"],
    "fundamentals": ["date", "ticker", "fcf_yield", "debt_to_equity", "roe",
                     "revenue_growth", "pe", "ev_ebitda", "dividend_yield"],
    "macro": ["date"],
}
OPTIONAL_FUNDAMENTALS = ["interest_coverage", "gross_margin", "operating_margin",
                         "free_cash_flow_margin", "eps_revision", "shares_dilution", "sector"]

# The 13 numeric attributes kept in the fundamentals store.
FUNDAMENTAL_FIELDS = [
    "fcf_yield", "debt_to_equity", "roe", "revenue_growth", "pe", "ev_ebitda",
    "dividend_yield", "interest_coverage", "gross_margin", "operating_margin",
    "free_cash_flow_margin", "eps_revision", "shares_dilution",
]

# Vendor record field -> canonical attribute.
METRIC_FIELDS = {
    "freeCashFlowYield": "fcf_yield",
    "debtToEquity": "debt_to_equity",
    "roe": "roe",
    "peRatio": "pe",
    "enterpriseValueOverEBITDA": "ev_ebitda",
    "dividendYield": "dividend_yield",
    "revenuePerShare": "revenue_per_share",
}
RATIO_FIELDS = {
    "interestCoverage": "interest_coverage",
    "grossProfitMargin": "gross_margin",
    "operatingProfitMargin": "operating_margin",
}

# Public series code -> macro column.
SERIES_CODES = {
    "DGS10": "rate_10y",
    "DGS2": "rate_2y",
    "CPIAUCSL": "cpi_index",
    "DCOILWTICO": "wti_oil",
    "BAMLH0A0HYM2": "credit_spread",
    "^VIX": "vix",
    "^GSPC": "benchmark_adj_close",
    "GC=F": "gold",
    "CADUSD=X": "cadusd",
}

# Macro series the publication gate insists on.
REQUIRED_SERIES = ["credit_spread", "rate_10y", "vix", "benchmark_adj_close"]

# Wording attached to a surviving (factor, macro state) pair.
HINTS = {
    ("fcf_yield", "credit_spread_z"):
        "consistent with the market rewarding internally funded businesses when external capital is expensive",
    ("debt_to_equity_inv", "credit_spread_z"):
        "consistent with a rising penalty on refinancing risk when credit conditions tighten",
    ("interest_coverage", "credit_spread_z"):
        "consistent with debt-service capacity mattering more under credit stress",
    ("earnings_yield", "rate_10y_z"):
        "consistent with valuation discipline mattering more when discount rates are high",
    ("dividend_yield", "rate_10y_z"):
        "consistent with yield competition from bonds affecting the payoff to dividend payers",
    ("momentum_6m", "bench_trend_6m"):
        "consistent with momentum being a trending-market phenomenon",
    ("revenue_growth", "rate_10y_chg_3m"):
        "consistent with long-duration growth repricing when rates move",
    ("commodity_sensitivity", "cpi_yoy_z"):
        "consistent with commodity-linked revenues acting as an inflation hedge",
}
DEFAULT_HINT = "mechanism not pre-mapped — interpret with care"

# Readings of the persistence test.
NO_HISTORY = "inconclusive (insufficient history)"
NOISE = "inconclusive (not distinguishable from noise)"
MOMENTUM = "persistent (momentum in payoff)"
REVERTING = "mean-reverting"

# Small-sample notices of the walk-forward summary; {n} is the number of dates.
FEW_PERIODS = ("Only {n} real historical rebalance period(s) available -- treat this as exploratory, not a "
               "validated backtest, until more real history accumulates.")
NO_PERIODS = "No rebalance periods had enough trailing history to evaluate."
