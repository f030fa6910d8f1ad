"""python -m waymark.plans.cli plan --source-url URL (--target-url URL | --target-schema FILE) [options]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..operators.profile import profile_catalog
from ..sources.catalog import load_spec
from ..sources.reflect import connect
from . import report
from .planner import build_plan


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="waymark", description=__doc__)
    plan = p.add_subparsers(dest="command", required=True).add_parser("plan", help="analyse two schemas and write a plan")
    plan.add_argument("--source-url", required=True)
    goal = plan.add_mutually_exclusive_group(required=True)
    goal.add_argument("--target-url")
    goal.add_argument("--target-schema")
    plan.add_argument("--output-dir", default="out")
    plan.add_argument("--profile", action=argparse.BooleanOptionalAction, default=True)
    plan.add_argument("--offline", action="store_true")
    plan.add_argument("--sample-size", type=int, default=5, help="values sampled for each column")
    return p


def run_plan(args: argparse.Namespace, spark: SparkSession | None = None) -> int:
    spark = spark or SparkSession.builder.appName("waymark").getOrCreate()
    source, read = connect(spark, args.source_url)
    profiles = samples = None
    if args.profile:
        profiles, source, samples = profile_catalog(spark, source, read, sample_size=args.sample_size)
    target = load_spec(args.target_schema) if args.target_schema else connect(spark, args.target_url)[0]
    plan = build_plan(spark, source, target, profiles, offline=args.offline, samples=samples)
    for path in report.write(plan, args.output_dir):
        print(f"Wrote {path}")
    print(f"Source tables: {len(source.names)}. Risks: {len(plan.risks)}. Checks to run: {len(plan.validation_plan)}.")
    return 0


def main(argv: list[str] | None = None) -> int:
    return run_plan(parser().parse_args(argv))


if __name__ == "__main__":
    raise SystemExit(main())
