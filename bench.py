"""Time the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

    python bench.py            headline queries
    python bench.py all        every registered query
    python bench.py a6 w13 ... queries whose name starts with one of these
"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paneloom.session import get_session  # noqa: E402
from paneloom.workloads.registry import QUERIES  # noqa: E402

HEADLINE = [
    "s1_header_scan", "s7_month_end_last", "s11_universe_scan", "s15_keep_last", "s16_upsert",
    "s21_fingerprint", "q4_duplicate_count", "q8_audit_stats", "q13_gate_verdict",
    "j1_asof_by_key", "j1_asof_in_spans", "j2_attach_macro", "a1_rebalance_calendar", "a3_rank_ic",
    "a3_rank_ic_split", "a6_factor_scores", "a6_factor_scores_split", "a10_theme_scores",
    "a12_theme_weights", "a14_walk_forward", "a19_commodity_sensitivity", "i1_bh_fdr",
    "i2_interaction_tests", "i3_payoff_persistence", "w1_pad_filled_return", "w2_winsorise",
    "w3_pct_rank", "w4_rank_factors", "w4_rank_sector_neutral", "w8_macro_states",
    "w10_low_volatility", "w13_price_features", "k2_top_entities_as_of",
]


def main(args):
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", int(cpus), spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    if args == ["all"]:
        names = list(QUERIES)
    elif args:
        names = [n for n in QUERIES if n.startswith(tuple(args))]
    else:
        names = [n for n in HEADLINE if n in QUERIES]
    QUERIES["a17_latest_per_entity"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for n in names:
        t0 = time.perf_counter()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "total wall-clock of headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main(sys.argv[1:])
