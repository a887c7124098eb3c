"""Row numbers in input order without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def numbered(rows: DataFrame, order: str, out: str = "row_number") -> DataFrame:
    """Number rows from 1 by a monotonically increasing id column.

    The id's upper bits are the input partition.  Rows are numbered within it and offset by the counts of earlier
    partitions, a table of one row per partition.
    """
    part = F.shiftright(order, 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    joined = rows.withColumn("_part", part).withColumn("_within", within).join(F.broadcast(offsets), "_part")
    return joined.withColumn(out, (F.col("_offset") + F.col("_within")).cast("int")).drop("_part", "_within", "_offset")
