"""Input contracts as Spark DDL."""

from paneloom.vocab import FUNDAMENTAL_FIELDS

PRICES = "date DATE, ticker STRING, adj_close DOUBLE, volume DOUBLE"
FUNDAMENTALS = ("date DATE, ticker STRING, "
                + ", ".join(f"{c} DOUBLE" for c in FUNDAMENTAL_FIELDS) + ", sector STRING")
MACRO = ("date DATE, benchmark_adj_close DOUBLE, rate_10y DOUBLE, rate_2y DOUBLE, cpi_yoy DOUBLE, "
         "wti_oil DOUBLE, vix DOUBLE, credit_spread DOUBLE, cadusd DOUBLE, gold DOUBLE")
MACRO_STORE = ("series_name STRING, observation_date DATE, release_date DATE, value DOUBLE, "
               "provider STRING, retrieved_at TIMESTAMP, raw_payload_hash STRING")
PRICE_STORE = ("ticker STRING, date DATE, adj_close DOUBLE, volume DOUBLE, provider STRING, "
               "retrieved_at TIMESTAMP, raw_payload_hash STRING")
FUNDAMENTAL_STORE = ("ticker STRING, period_end_date DATE, provider STRING, filing_date DATE, "
                     "accepted_date DATE, availability_date DATE, "
                     + ", ".join(f"{c} DOUBLE" for c in FUNDAMENTAL_FIELDS)
                     + ", sector STRING, retrieved_at TIMESTAMP, raw_payload_hash STRING")
