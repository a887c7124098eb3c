"""The log: skipped lines, failed requests and outcomes, on Python's logger `rayline`."""

from __future__ import annotations

import logging
import sys
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

from ..schema import ERROR, PASS

log = logging.getLogger("rayline")


@contextmanager
def to_console(level: int = logging.INFO) -> Iterator[None]:
    """For a while, lines with time, level and logger on standard error."""
    handler, before = logging.StreamHandler(sys.stderr), log.level
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)-5s %(name)s - %(message)s", "%H:%M:%S"))
    log.addHandler(handler)
    log.setLevel(level)
    try:
        yield
    finally:
        log.removeHandler(handler)
        log.setLevel(before)


def log_skipped(bad: DataFrame) -> int:
    """A warning for each line (row_number, line, reason) that is no case; their number."""
    count = 0
    for row in bad.orderBy("row_number").toLocalIterator():
        log.warning("line %d skipped: %s", row["row_number"], row["reason"])
        count += 1
    return count


def log_outcomes(results: DataFrame) -> None:
    """A line for each evaluated case: errors as warnings."""
    for row in results.select("row_number", "outcome", "target_road", "detected_road", "error_message").orderBy("row_number").toLocalIterator():
        if row["outcome"] == ERROR:
            log.warning("case %d failed: %s", row["row_number"], row["error_message"])
        else:
            log.info("case %d %s: expected %s, detected %s", row["row_number"], "passed" if row["outcome"] == PASS else "missed", row["target_road"], row["detected_road"])
