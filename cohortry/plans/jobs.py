"""Command line for spark-submit: build the tables, run a digest, load new months."""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import SparkSession

from cohortry.plans.digest_run import run_and_store
from cohortry.plans.warehouse import StoredWarehouse, build
from cohortry.sources.delimited import read_and_observe, require_few
from cohortry.sources.tables import TableSet
from cohortry.spec import PanelSpec, Window
from cohortry.streaming.incremental import IncrementalLoad

DIGEST_TABLE = "mart_digest_cache"


def _arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="cohortry")
    parser.add_argument("--root", required=True, help="folder of the tables")
    parser.add_argument("--panel-start", type=dt.date.fromisoformat, required=True, help="first month, as yyyy-mm-01")
    parser.add_argument("--panel-end", type=dt.date.fromisoformat, required=True, help="last month, as yyyy-mm-01")
    jobs = parser.add_subparsers(dest="job", required=True)

    whole = jobs.add_parser("build", help="write all tables from a raw panel")
    whole.add_argument("--source", required=True)
    whole.add_argument("--format", choices=("csv", "parquet"), default="csv")
    whole.add_argument("--max-bad", type=int, default=100)
    whole.add_argument("--plain-lines", action="store_true", help="no line breaks inside fields: files may be split")

    digest = jobs.add_parser("digest", help="run one digest and merge it into the digest table")
    digest.add_argument("--run-id", required=True)
    digest.add_argument("--window", default=Window.MSA_6.value)
    digest.add_argument("--cohort")
    digest.add_argument("--prior-cohort")

    load = jobs.add_parser("load", help="merge raw files that have not been loaded yet")
    load.add_argument("--source", required=True)
    load.add_argument("--checkpoint", required=True)
    load.add_argument("--format", choices=("csv", "parquet"), default="csv")
    load.add_argument("--files-per-batch", type=int, default=1)
    load.add_argument("--max-bad", type=int, default=100)
    load.add_argument("--plain-lines", action="store_true", help="no line breaks inside fields: files may be split")
    return parser.parse_args(argv)


def _build(spark: SparkSession, args: argparse.Namespace, spec: PanelSpec, tables: TableSet) -> None:
    if args.format == "parquet":
        build(spark.read.parquet(args.source), spec, tables)
        return
    raw, counted = read_and_observe(spark, args.source, quoted_newlines=not args.plain_lines)
    build(raw, spec, tables, lambda: require_few(counted.get["bad"], args.max_bad))


def main(argv: Sequence[str] | None = None) -> str:
    args = _arguments(argv)
    spark = SparkSession.builder.appName(f"cohortry-{args.job}").getOrCreate()
    spec = PanelSpec(args.panel_start, args.panel_end)
    tables = TableSet(spark, args.root)
    if args.job == "build":
        _build(spark, args, spec, tables)
        return f"built {args.root}"
    if args.job == "digest":
        return run_and_store(
            spark, StoredWarehouse(tables, spec), tables.path(DIGEST_TABLE), args.run_id, args.window,
            cohort=args.cohort, prior_cohort=args.prior_cohort,
        )
    IncrementalLoad(tables, spec).run(
        spark, args.source, args.checkpoint, args.format, args.files_per_batch, args.max_bad, not args.plain_lines
    )
    return f"loaded {args.source}"


if __name__ == "__main__":
    print(main())
