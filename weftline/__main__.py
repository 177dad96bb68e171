"""Command line: python -m weftline list | run | tables | audit.

list              names of all queries; with --sql, those that have SQL for checking
run NAME ...      writes each query's rows under --out as NAME.parquet, or shows the first ones
tables            the fixed set of result tables as CSV, with a manifest of inputs and counts
audit             invariants of the tables; exit code 1 if one fails
"""

from __future__ import annotations

import argparse
import glob
import os
import sys

from pyspark.sql import SparkSession

from weftline.operators import audit
from weftline.plans.catalog import QUERIES, SQL
from weftline.sources import tables

RESULTS = ("pool_counts", "outcome_battery", "mh_robustness", "sample_audit", "near_miss_reconcile", "dup_sweep", "composition", "concentration", "language_rollup", "agreement_report", "episode_metrics")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="do", required=True)
    sub.add_parser("list").add_argument("--sql", action="store_true")
    for name in ("run", "tables", "audit"):
        c = sub.add_parser(name)
        c.add_argument("--data", required=True, help="folder of the input tables")
        if name == "run":
            c.add_argument("names", nargs="+", metavar="NAME")
        if name != "audit":
            c.add_argument("--out", required=name == "tables", help="folder of the results")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit code; the session is made here unless given."""
    a = parser().parse_args(argv)
    if a.do == "list":
        print("\n".join(n for n in QUERIES if not a.sql or n in SQL))
        return 0
    if unknown := sorted(set(getattr(a, "names", ())) - set(QUERIES)):
        print(f"no such query: {', '.join(unknown)}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("weftline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.do == "audit":
        report = QUERIES["audit_report"](spark, a.data).persist()
        report.show(100, truncate=False)
        return audit.exit_code(report)
    if a.do == "run":
        for n in a.names:
            df = QUERIES[n](spark, a.data)
            df.write.mode("overwrite").parquet(f"{a.out}/{n}.parquet") if a.out else df.show(20, truncate=False)
        return 0
    counts = {}
    for n in RESULTS:
        tables.write_table(QUERIES[n](spark, a.data), f"{a.out}/{n}.csv")
        counts[n] = spark.read.csv(f"{a.out}/{n}.csv", header=True).count()
    inputs = {os.path.basename(f): f for f in glob.glob(f"{a.data}/*.parquet") if os.path.isfile(f)}
    tables.write_json(f"{a.out}/manifest.json", tables.manifest(inputs, counts))
    return 0


if __name__ == "__main__":
    sys.exit(main())
