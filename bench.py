"""Headline timings as one JSON line. The scan is inside every timed span.

The full report runs first on a cold JVM and again warm; the other queries run once warm.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from checks.views import scratch_folder, view  # noqa: E402
from tablecheck import TableMetrics, quality_report  # noqa: E402
from tablecheck.operators.duplicates import duplicate_rows  # noqa: E402
from tablecheck.plans import eda  # noqa: E402
from tablecheck.session import local_session  # noqa: E402
from tablecheck.sources import delimited, jsonlines, loader, logs  # noqa: E402


def report(spark, sf, name):
    found = quality_report(view(spark, sf, name))
    found.as_json().first()
    found.metrics.release()


def metric(spark, sf, name, section):
    m = TableMetrics(view(spark, sf, name))
    section(m)
    m.release()


def noop(frame):
    frame.write.format("noop").mode("overwrite").save()


def fingerprints(spark, sf):
    duplicate_rows(view(spark, sf, "lineitem"))


def delimited_text(spark, sf):
    names = ["key", "customer", "price", "even", "note", "day"]
    rows, _ = delimited.parse_delimited(view(spark, sf, "order_lines"), names)
    noop(delimited.typed(rows))


def json_text(spark, sf):
    noop(jsonlines.parse_json_lines(view(spark, sf, "json_lines"))[0])


def csv_folder(spark, sf):
    """The line items as CSV files, written before anything is timed."""
    if sf not in CSV:
        CSV[sf] = scratch_folder(spark)
        view(spark, sf, "lineitem").write.option("header", True).csv(CSV[sf])
    return CSV[sf]


def report_from_csv(spark, sf):
    found = quality_report(loader.load(spark, csv_folder(spark, sf)).data)
    found.as_json().first()
    found.metrics.release()


CSV: dict[str, str] = {}
QUERIES = {
    "report_lineitem_cold": lambda s, d: report(s, d, "lineitem"),
    "report_lineitem": lambda s, d: report(s, d, "lineitem"),
    "report_dirty_orders": lambda s, d: report(s, d, "dirty_orders"),
    "report_web_log": lambda s, d: report(s, d, "web_log"),
    "exact_quartiles": lambda s, d: metric(s, d, "lineitem", lambda m: m.quartile(m.numeric[0], 0.5)),
    "distinct_counts": lambda s, d: metric(s, d, "lineitem", lambda m: [m.distinct(c) for c in m.columns]),
    "duplicate_fingerprints": fingerprints,
    "correlation": lambda s, d: metric(s, d, "lineitem", eda.correlation_matrix),
    "histograms": lambda s, d: metric(s, d, "lineitem", eda.histograms),
    "text_value_counts": lambda s, d: metric(s, d, "documents", eda.top_values),
    "parse_apache_log": lambda s, d: noop(logs.parse_log(view(s, d, "log_lines"), "apache_combined")),
    "parse_delimited": delimited_text,
    "parse_json_lines": json_text,
    "full_report_from_csv": report_from_csv,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cores, shuffle_partitions=int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    rows = view(spark, sf_dir, "lineitem").agg(F.count("*")).first()[0]
    csv_folder(spark, sf_dir)
    seconds = {}
    for name, run in QUERIES.items():
        start = time.perf_counter()
        run(spark, sf_dir)
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "full_report_lineitem_warm",
                "value": seconds["report_lineitem"],
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "lineitem_rows": rows,
                "cores": int(cores),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
