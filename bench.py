"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3, the
median counts). Every query is computed in full into Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

HEADLINE = (
    "G1_G2_clim_mean_std", "G3_derived_std", "G7_seasonal_mean", "G8_V12_zonal_mean", "G9_zonal_covariance",
    "G13_sample_percentiles", "W1_eddy", "J6_D3_same_month_anomaly", "D4_zscore_floor",
    "D10_J8_sliding_composite_anomaly", "K16_J7_sliding_series_anomaly", "V1_J9_isentropic", "V4_J11_bilinear_sample",
    "V13_arc_section", "K1_W6_streamfunction", "K5_ep_flux", "K6_K7_m_budget", "K11_h_budget", "K13_lorenz_sorted",
    "S9_S10_quantize_roundtrip", "D1_climatology_field", "D4_zscore_view", "D14_display_range",
)


def main() -> None:
    from zonalis.plans.catalogue import QUERIES
    from zonalis.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(f"local[{cpus}]", 2 * cpus, app="zonalis-bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["G1_per_year_monthly"](spark, sf_dir).write.format("noop").mode("overwrite").save()      # warm the JVM

    timings = {}
    for name in HEADLINE:
        took = []
        for _ in range(runs):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(took), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                      "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
