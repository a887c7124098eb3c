"""Scoring detections against labelled cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import NO_NAME, fuzzy_match
from ..schema import ERROR, FAIL, PASS

WRONG = "Wrong road on both directions"


def evaluated(cases: DataFrame) -> DataFrame:
    """Add the outcome to rows with target_road, current_road, road_name, alternative_road_name and error.

    An error is ERROR with no detected road.  Otherwise the primary name is tried, then the alternative; a missing
    name is `UNKNOWN` and matches nothing.  The detected road is the name that matched, or both names.
    `primary_is_current_road` is told but decides nothing, and iterations is always 0.
    """
    primary, other = (F.coalesce(F.col(c), F.lit(NO_NAME)) for c in ("road_name", "alternative_road_name"))
    failed = F.col("error").isNotNull()
    first, second = fuzzy_match(primary, F.col("target_road")), fuzzy_match(other, F.col("target_road"))
    ranked = cases.withColumn("_hit", F.when(failed, 3).when(first, 0).when(second, 1).otherwise(2))
    hit = F.col("_hit")
    return ranked.withColumns(
        {
            "outcome": F.when(hit == 3, ERROR).when(hit <= 1, PASS).otherwise(FAIL),
            "detected_road": F.when(hit == 3, "").when(hit == 0, primary).when(hit == 1, other).otherwise(F.concat_ws(" / ", primary, other)),
            "iterations": F.lit(0),
            "alternative_used": hit == 1,
            "error_message": F.when(hit == 3, F.col("error")).when(hit == 2, WRONG),
            "primary_is_current_road": ~failed & fuzzy_match(primary, F.col("current_road")),
        }
    ).drop("_hit")


def outcome_label(outcome: Column, alternative: Column) -> Column:
    """PASS, PASS (alt), FAIL or ERROR, padded to 15 characters."""
    return F.rpad(F.when((outcome == PASS) & alternative, "PASS (alt)").otherwise(outcome), 15, " ")


def tallies() -> list[Column]:
    """Counts and success rate (per cent; NaN without cases) of one group, for a single aggregation."""
    is_ = lambda o: F.col("outcome") == o
    passed = F.count_if(is_(PASS))
    return [
        F.count("*").alias("total"),
        passed.alias("passed"),
        F.count_if(is_(PASS) & ~F.col("alternative_used")).alias("passed_direct"),
        F.count_if(is_(PASS) & F.col("alternative_used")).alias("passed_alternative"),
        F.count_if(is_(FAIL)).alias("failed"),
        F.count_if(is_(ERROR)).alias("errors"),
        F.coalesce(F.try_divide(passed * F.lit(100.0), F.count("*").cast("double")), F.lit(float("nan"))).alias("success_rate"),
    ]


def summary(results: DataFrame) -> DataFrame:
    """One row of tallies over all results."""
    return results.agg(*tallies())


def summary_by(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tallies by the keys, with subtotals from right to left and a grand total (null keys)."""
    return results.rollup(*keys).agg(*tallies())
