"""Command line: profile a CSV file (or another table) and write reports.

    python -m quillon.cli --input people.csv --output-dir reports [--mask-password ...] [--profile v13 ...]
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from quillon.fixed import PROFILES
from quillon.operators.decide import OLD_RESULT, RESULT
from quillon.operators.reports import terminal_summary, write_csv, write_reports
from quillon.plans.profile import profile_tables
from quillon.sources.tables import policy_overlay, read_csv, read_table
from quillon.work import stash


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Profile the columns of a table for personal data, and protect them.")
    p.add_argument("--input", required=True)
    p.add_argument("--format", default="csv", help="csv, parquet, orc, json, ...")
    p.add_argument("--output-dir", default="reports")
    p.add_argument("--profile", choices=sorted(PROFILES), default="v16")
    p.add_argument("--columns", nargs="*")
    p.add_argument("--max-samples", type=int)
    p.add_argument("--mask-password")
    p.add_argument("--policy-config", help="JSON file that Spark can read")
    p.add_argument("--encoding", default="UTF-8")
    p.add_argument("--delimiter", default=",")
    p.add_argument("--single-line", action="store_true", help="no cell holds a line break, so that CSV files can be split among tasks")
    p.add_argument("--region", default="IN", help="kept for compatibility; has no effect")
    p.add_argument("--language", default="en", help="kept for compatibility; has no effect")
    return p


def main(argv: Sequence[str] | None = None) -> dict[str, str]:
    args = arguments().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    profile = PROFILES[args.profile]
    if args.format == "csv":
        table = read_csv(spark, args.input, args.profile == "v13", args.encoding, args.delimiter, args.columns, not args.single_line)
    else:
        table = read_table(spark, args.input, args.format, args.columns)
    policy = policy_overlay(spark.read.text(args.policy_config, wholetext=True).first()[0]) if args.policy_config else None
    out = profile_tables(table, policy=policy, profile=profile, samples=args.max_samples).results
    results = stash(out, "results").orderBy("place")
    if args.profile == "v13":
        paths = {"report": write_csv(results.select(*OLD_RESULT), f"{args.output_dir}/report", True)}
    else:
        paths = write_reports(results.select(*RESULT), table, args.output_dir, args.mask_password)
    print(terminal_summary(results))
    for name, path in paths.items():
        print(f"{name}: {path}")
    return paths


if __name__ == "__main__":
    main()
