"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``: median of three runs after a warm-up, one JSON line."""

from __future__ import annotations

import importlib
import importlib.util
import json
import os
import statistics
import time

from pyspark.sql import DataFrame

from quadrille.queries import QUERIES
from quadrille.session import session

HEADLINE = {
    "B1_scan_count": "scan_count", "B2_filter_project": "project_filter_cte", "B3_envelope_filter": "sp_filter_envelope", "B4_group_count_min_max": "agg_group_one", "B5_equi_join": "join_lookup",
    "B6_spatial_join_native": "sp_join_events", "B7_spatial_join_wkb": "sp_join_contains_wkb", "B8_dwithin_join": "sp_join_dwithin", "B9_top_k": "limit_top_k", "B10_update_delete": "dml_update_then_delete",
}


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    todo = {name: (QUERIES[q], 3) for name, q in HEADLINE.items()}
    if importlib.util.find_spec("quadrille.llm"):
        registry = importlib.import_module("quadrille.llm.registry")
        todo |= {name: (q, 1) for name, q in registry.QUERIES.items()}
    seconds = {}
    for name, (query, repeats) in todo.items():
        run(query(spark, sf_dir))
        times = []
        for _ in range(repeats):
            began = time.perf_counter()
            run(query(spark, sf_dir))
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times), 3)
    total = round(sum(v for k, v in seconds.items() if k in HEADLINE), 3)
    print(json.dumps({"metric": "sum of medians of B1-B10", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
