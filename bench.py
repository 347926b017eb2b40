"""Time the headline queries and print one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Every query runs
once to warm up the JVM and then three times; the median is reported. Results go to the
no-op sink, so all rows and columns are computed and none are collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from hazegrid.plans.catalog import QUERIES  # noqa: E402
from hazegrid.session import local_session  # noqa: E402

HEADLINE = [
    "a01_pivot_wide", "w01_deduplicate", "w02_carry_forward_bulk", "w03_carry_forward_rows", "w04_clean_store",
    "w05_fill_gaps_long", "a12_clip_outliers", "j01_station_weather", "j10_population_square",
    "j12_nearest_weather_point", "p13_aqi_strict", "a30_station_aqi", "a08_scores_station_season", "a05_burden_table",
    "w10_impact_rank", "a23_correlations", "a24_describe", "w06_lags_and_lead", "m06_persistence", "r03_daily_means_hourly",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    shared = tempfile.TemporaryDirectory(prefix="bench-")
    spark = local_session(cores=cpus, shuffle_partitions=cpus, **{"spark.checkpoint.dir": shared.name})
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    times: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            begun = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - begun)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus}))
    spark.stop()
    shared.cleanup()


if __name__ == "__main__":
    main()
