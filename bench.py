"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import time

from archlens import registry, session

HEADLINE = [
    "flagship", "agg_01", "agg_04", "agg_07", "agg_14", "agg_17", "agg_18", "agg_19", "agg_22",
    "agg_28", "scl_05", "scl_09", "scl_15", "src_02", "jon_01", "jon_02", "jon_03", "jon_06",
    "jon_07", "jon_09", "win_02", "win_04", "win_08", "win_11", "win_13", "set_01", "set_02",
    "dec_06", "dec_12", "dec_19", "dec_20", "dec_22", "sig_03", "sig_05", "sig_06", "sig_11",
    "sig_12", "dec_24", "str_02", "str_03",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    registry.load()
    spark = session.local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # one small query first: JVM and worker start-up are not the queries' cost
    registry.QUERIES["scl_02"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for key in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[key] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
