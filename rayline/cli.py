"""Command line: detect one pair of fixes, or evaluate a file of cases, against lookup tables on disk.

    python -m rayline.cli detect [PREVIOUS CURRENT] --tables DIR
    python -m rayline.cli evaluate [CASES] [RESULTS] --tables DIR [--images DIR]
    python -m rayline.cli fetch [CASES] --tables DIR --settings FILE

The tables are parquet folders tiles, snaps and places (see rayline.schema); fetch asks the live services for what they
lack.
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession

from .config import Settings, load
from .operators.detect import detect, result_text
from .operators.evaluate import evaluated
from .sinks.overlay import overlays, save_overlays
from .sinks.log import log_outcomes, log_skipped, to_console
from .sinks.results import report_lines, write_results
from .sources.cases import bad_lines, read_cases, single_pair
from .sources.live import fill_tables

CASES, RESULTS = "cases.csv", "results/evaluation-results.csv"


def tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{folder}/{t}") for t in ("tiles", "snaps", "places"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rayline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("action", choices=["detect", "evaluate", "fetch"])
    parser.add_argument("args", nargs="*")
    parser.add_argument("--tables", required=True)
    parser.add_argument("--settings")
    parser.add_argument("--images")
    parser.add_argument("--quiet", action="store_true", help="log warnings only")
    o = parser.parse_args(argv)
    with to_console(logging.WARNING if o.quiet else logging.INFO):
        return act(o, spark or SparkSession.builder.appName("rayline").getOrCreate())


def act(o: argparse.Namespace, spark: SparkSession) -> int:
    """What the arguments ask for; the exit status."""
    settings = load(o.settings) if o.settings else Settings()
    try:
        if o.action == "fetch":
            fill_tables(spark, read_cases(spark, (o.args or [CASES])[0]), o.tables, settings)
            return 0
        lookups = tables(spark, o.tables)
        if o.action == "detect":
            found = detect(single_pair(spark, o.args), *lookups, settings)
            row = found.select(result_text(found).alias("text"), "error").first()
            if row["error"]:
                raise ValueError(row["error"])
            print(row["text"])
        else:
            source, target = (o.args + [CASES, RESULTS][len(o.args) :])[:2]
            log_skipped(bad_lines(spark, source))
            results = evaluated(detect(read_cases(spark, source), *lookups, settings)).persist()
            log_outcomes(results)
            for line in report_lines(results):
                print(line)
            write_results(results, target)
            if o.images:
                save_overlays(overlays(results, lookups[0], settings.metres_per_pixel), o.images)
            results.unpersist()
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
