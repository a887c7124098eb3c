"""Decisions by counted size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A side of a join is broadcast only if it was counted and has at most so many (narrow) rows.
BROADCAST_ROWS = 500_000


#: Tasks a core when rows are spread for work in Python.
TASKS_A_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt out to all cores if it comes in fewer parts: a small file is one part however long its rows take."""
    tasks = TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def gated(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast `df` if its counted rows are at most `most`; otherwise leave the join to shuffle.

    `df` should be narrow and cheap to compute again: it is counted here.
    """
    return F.broadcast(df) if df.count() <= most else df
