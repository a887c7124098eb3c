"""Result files and the text report."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import coordinate_text, yes_no
from ..operators.evaluate import outcome_label, summary

HEADER = "Row;Previous Coordinates;Current Coordinates;Current Road;Target Road;Detected Road;Result;Iterations;AltUsed;City"
COLUMNS = HEADER.split(";")


def _point(name: str) -> Column:
    return coordinate_text(F.col(f"{name}.lat"), F.col(f"{name}.lon"))


def csv_line(row: Column, previous: Column, current: Column, *rest: Column) -> Column:
    """One line: the two coordinate fields in quotes, nothing escaped."""
    quoted = [F.concat(F.lit('"'), c, F.lit('"')) for c in (previous, current)]
    return F.concat_ws(";", row.cast("string"), *quoted, *[c.cast("string") for c in rest])


def result_line(results: DataFrame) -> DataFrame:
    rest = [F.col(c) for c in ("current_road", "target_road", "detected_road", "outcome", "iterations")]
    line = csv_line(F.col("row_number"), _point("previous"), _point("current"), *rest, yes_no(F.col("alternative_used")), F.col("city"))
    return results.select("row_number", line.alias("value"))


def write_results(results: DataFrame, path: str) -> None:
    """One file at `path`, lines in order of row number, made as a stream of rows; its folder is made if needed.

    The format escapes nothing, so fields must not hold `;`.  For others, or on a cluster, use write_results_csv().
    """
    if folder := os.path.dirname(path):
        os.makedirs(folder, exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.write(HEADER + "\n")
        for row in result_line(results).orderBy("row_number").toLocalIterator():
            f.write(row["value"] + "\n")


def write_results_csv(results: DataFrame, folder: str) -> None:
    """A folder of properly quoted CSV files with the same columns, written by Spark."""
    values = [F.col("row_number"), _point("previous"), _point("current"), *[F.col(c) for c in ("current_road", "target_road", "detected_road", "outcome", "iterations")], yes_no(F.col("alternative_used")), F.col("city")]
    results.select(*[v.alias(c) for v, c in zip(values, COLUMNS, strict=True)]).write.option("sep", ";").option("header", True).mode("overwrite").csv(folder)


def case_line(row: Column, outcome: Column, alternative: Column, target: Column, detected: Column) -> Column:
    return F.format_string("  #%03d | %s | Target: %-25s | Got: %s", row, outcome_label(outcome, alternative), target, detected)


RULE = "=" * 90
#: Lines before the cases, and where the lines after them begin in order.
HEAD, TAIL_AT = ("", RULE, "  EVALUATION RESULTS", RULE), 1 << 40


def summary_line_columns() -> list[Column]:
    """The six lines of a row of tallies."""
    count = lambda label, name: F.format_string("  %-20s %d/%d", F.lit(label), F.col(name), F.col("total"))
    return [
        count("PASS (direct):", "passed_direct"),
        count("PASS (alternative):", "passed_alternative"),
        count("PASS (total):", "passed"),
        count("FAIL:", "failed"),
        count("ERROR:", "errors"),
        F.format_string("  %-20s %.1f%%", F.lit("Success rate:"), F.col("success_rate")),
    ]


def summary_lines(results: DataFrame) -> list[str]:
    return list(summary(results).select(F.array(*summary_line_columns())).first()[0])


def report_frame(results: DataFrame) -> DataFrame:
    """The report as rows (position, line): a line per case in order, then the summary."""
    head = results.sparkSession.createDataFrame(list(enumerate(HEAD, -len(HEAD))), "position long, line string")
    line = case_line(F.col("row_number"), F.col("outcome"), F.col("alternative_used"), F.col("target_road"), F.col("detected_road"))
    tail = F.array(F.lit(""), F.lit(RULE), F.lit("  SUMMARY"), F.lit(RULE), *summary_line_columns(), F.lit(RULE))
    closing = summary(results).select(F.posexplode(tail).alias("i", "line")).select((F.col("i") + TAIL_AT).alias("position"), "line")
    return head.union(results.select(F.col("row_number").cast("long"), line)).union(closing)


def report_lines(results: DataFrame) -> Iterator[str]:
    """The report as a stream; the driver holds one partition at a time."""
    for row in report_frame(results).orderBy("position").toLocalIterator():
        yield row["line"]


def report(results: DataFrame) -> str:
    """The whole report as one text, for few cases."""
    return "\n".join(report_lines(results))
