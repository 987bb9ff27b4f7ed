"""Gate, then run, then persist. A blocked or failed run leaves earlier results untouched."""

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame

from paneloom.operators import quality
from paneloom.plans import research
from paneloom.sources import readers, store

PERSISTED = ["factor_scores", "priority_scores", "interaction_tests", "latest_stock_ranks"]


@dataclass
class Outcome:
    status: str  # published | blocked | failed
    run_id: str | None
    checks: DataFrame
    message: str
    tables: dict | None = None


def publish(prices: DataFrame, macro_store: DataFrame, fundamental_store: DataFrame, universe: DataFrame,
            as_of, out, cfg: research.Config = research.Config(), gate=None) -> Outcome:
    """prices, macro_store and fundamental_store are the stored tables; `out` receives one
    partition per run, to be read with `store.read_runs`."""
    spark = prices.sparkSession
    checks = quality.gate_checks(prices, macro_store, fundamental_store, universe, as_of, **(gate or {}))
    verdict = quality.gate_verdict(checks).first()
    if not verdict["passed"]:
        return Outcome("blocked", None, checks, f"blocked by: {verdict['failures']}")
    names = [r[0] for r in macro_store.select("series_name").distinct().collect()]
    f = (readers.restrict_to_universe(fundamental_store, universe)
         .withColumnRenamed("period_end_date", "date"))
    f = f.select("date", "ticker", "retrieved_at", *[c for c in (*store.FUNDAMENTAL_FIELDS, "sector") if c in f.columns])
    run_id = str(uuid.uuid4())
    try:
        tables = research.run(readers.restrict_to_universe(prices.select("date", "ticker", "adj_close", "volume"), universe),
                              f, readers.long_to_wide(macro_store, sorted(names)), cfg, seq="retrieved_at")
        warnings = [w for w in verdict["warnings"].split(",") if w]
        row = store.run_row(spark, run_id, research.as_of(tables["factor_scores"]), cfg.as_dict(), warnings)
        store.persist_run({n: tables[n] for n in PERSISTED}, run_id, out, row)
    except Exception as e:
        return Outcome("failed", None, checks, f"{type(e).__name__}: {e}")
    return Outcome("published", run_id, checks, "published", tables)
