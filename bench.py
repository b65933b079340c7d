"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from quantloom import plans, session

HEADLINE = (
    "w01_adjust_prices", "w03_price_features", "w05_normalized_flow", "w07_restrict_universe", "w09_total_return_close", "w10_dividend_features",
    "w13_fundamental_features", "w18_series_stats_rolling", "w19_ewm_std", "q01_buffered_universe", "q02_backtest_equal", "q05_dedupe_events",
    "q07_lexicon_score", "a02_ic_summary", "a11_calendar_time_t", "a21_market_valuation", "a24_fund_summary", "a35_daily_news_table", "j15_screener", "k01_rankings",
)


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build(f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("OFF")
    queries = plans.queries()
    queries["k01_rankings"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else None}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
