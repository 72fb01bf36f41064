"""Time the headline queries and print one JSON line.

Reads ``$BENCH_SF_DIR`` (default sf0.1) on ``local[$BENCH_CPUS]``. Every query is
run once to warm up and then timed; its whole result is computed and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "ohlc_12h", "ohlc_weekly", "bars_median", "one_price_bars", "coarsen_bars", "log_returns_lags", "tick_log_returns",
    "rolling_last_n", "chrono_split", "ordered_scan_equity", "autocorr_matrix", "pair_corr", "histogram", "kde_grid",
    "roc_auc", "trade_results", "performance_summary", "compounding", "leverage_sweep", "timeframe_compare",
    "fills_ledger", "ar3_fit", "subset_search", "cv_rolling", "cv_expanding", "cv_huber", "walk_forward", "nn_forward",
    "tick_backtest", "stream_ohlc", "stream_lags", "flagship", "flagship_l1",
]


def main() -> None:
    from tidemark.catalog import QUERIES
    from tidemark.session import session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    names = sys.argv[1:] or HEADLINE
    spark = session("bench", f"local[{os.environ.get('BENCH_CPUS', os.cpu_count() or 4)}]")
    taken = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries, second run",
                "value": round(sum(taken.values()), 3),
                "unit": "sec",
                "queries": taken,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
