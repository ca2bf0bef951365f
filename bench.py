"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Times are medians of five warm runs.

`extraction` is the throughput of symbol and import extraction in files a second on 1, 2 and 4 cores.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession

from grovelens.plans import catalogue
from grovelens.sources import extract

HEADLINE = ("module_edges", "used_by", "key_files", "symbol_refcounts", "module_public_symbols", "dominant_value", "changeset", "ledger_merge", "prioritized_lookup", "first_root_wins", "suffix_match", "deepest_root", "nearest_name", "unused_tokens")
RUNS = 5
CORES = (1, 2, 4)


def session(cpus: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(frame: DataFrame) -> float:
    began = time.perf_counter()
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark, took = session(cpus), {}
    for name in HEADLINE:
        runs = []
        for _ in range(1 + RUNS):
            began = time.perf_counter()
            seconds(catalogue.QUERIES[name](spark, sf_dir))
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 4)
    spark.stop()
    throughput = {}
    for cores in CORES:
        spark = session(cores)
        files = catalogue.source_files(spark, sf_dir).repartition(4 * cores).persist()
        n = files.count()
        runs = [seconds(extract.extract(files)) for _ in range(1 + RUNS)]
        throughput[str(cores)] = round(n / statistics.median(runs[1:]), 1)
        spark.stop()
    print(json.dumps({"metric": "total of warm medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "extraction": throughput, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
