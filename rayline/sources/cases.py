"""Labelled cases from delimited text, by the exact rules of the case file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import let, parse_coordinate, split_fields, trimmed
from ..operators.ordinal import numbered


def parsed_line(line: Column) -> Column:
    """struct(previous, current, current_road, target_road, city, bad): one trimmed, non-blank line.

    The delimiter is `;` if the line has one, else `,`.  Empty fields at the end do not count; fewer than four fields,
    or a field that should be a coordinate and is none, make the line bad.  Field five is not read; a missing city
    is empty.  Quotes mean nothing.
    """
    delimited = F.when(F.contains(line, F.lit(";")), split_fields(line, ";")).otherwise(split_fields(line, ","))

    def fields(parts: Column) -> Column:
        city = F.when(F.size(parts) >= 6, F.get(parts, F.lit(5))).otherwise("")
        return F.struct(
            parse_coordinate(F.get(parts, F.lit(0))).alias("previous"), parse_coordinate(F.get(parts, F.lit(1))).alias("current"),
            F.get(parts, F.lit(2)).alias("current_road"), F.get(parts, F.lit(3)).alias("target_road"), city.alias("city"), F.size(parts).alias("fields"),
        )

    def told(case: Column) -> Column:
        bad = F.when(case["fields"] < 4, "fewer than four fields").when(case["previous"].isNull(), "bad previous coordinates").when(case["current"].isNull(), "bad current coordinates")
        return F.struct(*[case[c].alias(c) for c in ("previous", "current", "current_road", "target_road", "city")], bad.alias("bad"))

    return let(let(F.transform(delimited, trimmed), fields), told)


def case_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every numbered line of a file with its parse, bad ones too.

    The first line is a header and is dropped unread.  Blank lines have no number; bad lines have one.
    """
    rows = case_rows(spark.read.text(path).withColumn("_row", F.monotonically_increasing_id()))
    if rows is None:
        raise ValueError(f"{path} is empty")
    return rows


def case_rows(lines: DataFrame) -> DataFrame | None:
    """The same for lines (value, _row), in order of _row, whose bits from 33 on cut them into stretches; None for no line."""
    head = lines.agg(F.min("_row")).first()[0]
    if head is None:
        return None
    body = lines.where(F.col("_row") > head).withColumn("line", trimmed(F.col("value"))).where("line <> ''")
    return numbered(body, "_row").select("row_number", "line", parsed_line(F.col("line")).alias("case"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """The good cases: (row_number, previous, current, current_road, target_road, city)."""
    return case_lines(spark, path).where("case.bad is null").select("row_number", "case.previous", "case.current", "case.current_road", "case.target_road", "case.city")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that were skipped, and why."""
    return case_lines(spark, path).where("case.bad is not null").select("row_number", "line", F.col("case.bad").alias("reason"))


def single_pair(spark: SparkSession, args: list[str]) -> DataFrame:
    """One pair (previous, current) from two coordinate arguments; fewer arguments give the default pair, more are ignored."""
    texts = args[:2] if len(args) >= 2 else DEFAULT_PAIR
    row = spark.createDataFrame([tuple(texts)], "a string, b string").select(parse_coordinate(F.col("a")).alias("previous"), parse_coordinate(F.col("b")).alias("current"))
    if row.where("previous is null or current is null").head(1):
        raise ValueError(f"not coordinates: {texts}")
    return row


#: The default pair of fixes, previous then current.
DEFAULT_PAIR = ("37.988891, 23.741949", "37.988988, 23.741867")
