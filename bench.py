"""Time the headline jobs: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gridspark.catalog.all_jobs import JOBS  # noqa: E402
from gridspark.session import get_session  # noqa: E402

HEADLINE = [
    "q01_rt_avg_day", "q16_max_hourly_da_rt_gap_he", "q18_rt_avg_high_netload_month", "q25_longest_run_above",
    "q34_battery_best_arbitrage_da", "q37_battery_2h_optimal_da", "q39_price_spike_events", "q42_yoy_da_change",
    "t05_localize_posts", "j01_asof_vintages", "j04_latest_before_instant", "w01_gaps_long_history", "w04_causal_rolling",
    "w05_trailing_quantiles", "f01_forecast_frame", "p11_distinct_content", "m08_score_completions", "e02_outcome_report",
    "e05_paired_comparison", "r06_commitment_uplift", "x02_reasoning_text", "x05_clean_text", "x08_extract_query", "n01_chat_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("gridspark-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:] or HEADLINE
    JOBS["q02_da_max_month"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    times = {}
    for key in only:
        t0 = time.perf_counter()
        JOBS[key].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_jobs_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
