"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line (wall seconds, median of
$BENCH_RUNS runs). Every run derives its inputs anew from the parquet tables."""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = ["t0_bars_daily", "l8_panel", "l10_liquidity_metrics", "d10_adjusted_jumps", "i14_liquidity_daily", "c1_parse_subjects", "c10_adjust_bars", "f0_features", "f2_ema",
            "f16_relative_strength", "p9_attach_fundamentals", "r7_score", "r15_sweep", "t2_charges", "t8_first_exit_market_clock", "t13_touch_fills", "w12_gate", "b1_positions",
            "b2_running_cash", "b9_daily_snapshots", "x1_candles"]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from barloom.plans import all_queries
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    qs, out = all_queries(), {}
    for name in names:
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            qs[name].run(spark, sf_dir, fresh=True).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        out[name] = round(statistics.median(took), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
