"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sourcesift.operators.matching import scan_rules
from sourcesift.plans.corpora import mixed_corpus
from sourcesift.plans.queries import QUERIES
from sourcesift.rules.packs import PACKS

HEADLINE = [
    "scan_credentials", "scan_security", "scan_modern_crypto", "scan_network", "code_metrics",
    "extract_routes", "extract_modules", "hot_modules", "taint_seeds", "propagate_taint",
    "suppress_findings", "attack_surface_score", "shared_values", "corpus_rollup", "full_scan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # the first query of a session pays for class loading and compiling; that is not what is measured
    scan_rules(mixed_corpus(spark, sf_dir).limit(200), PACKS["credentials"]).write.format("noop").mode("overwrite").save()
    size = mixed_corpus(spark, sf_dir).agg(F.sum(F.octet_length("src"))).first()[0]
    times = {}
    for name in wanted:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    total = round(sum(times.values()), 3)
    out = {
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "corpus_mb": round(size / 1e6, 2),
    }
    if "full_scan" in times:
        out["full_scan_mb_per_sec"] = round(size / 1e6 / times["full_scan"], 3)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
