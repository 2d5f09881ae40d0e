"""Times the headline queries and prints one JSON line."""

import json
import os
import sys
import tempfile
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from tracelantern.plans import catalog

HEADLINE = (
    "event_log_lines", "ip_counts", "user_counts", "log_period", "ioc_totals", "ioc_domain_docs",
    "hits_all", "hits_pages", "hits_docs", "hits_per_rule", "findings_first_n", "timeline_500",
    "technique_hits", "correlation_matches", "threat_score", "recommendations",
    "file_report", "json_report", "stix_indicators",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    # the start of the JVM's and the Python workers' code is not timed
    for name in ("ip_counts", "hits_chats"):
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    for name in sys.argv[1:] or HEADLINE:
        each = []
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - start)
        times[name] = round(median(each), 3)
    print(json.dumps({
        "metric": "headline queries, total time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(folder).name,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
