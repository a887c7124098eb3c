"""Pairs of consecutive fixes of an entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .size import gated

#: An entity of more fixes than this is not ordered in one task.
MOST_FIXES = 1_000_000


def paired_fixes(fixes: DataFrame, entity: str, order: Sequence[str], lat: str = "lat", lon: str = "lon", most: int = MOST_FIXES) -> DataFrame:
    """Add prev_lat and prev_lon, the fix before in order; an entity's first fix has none and is left out.

    The fixes of an entity are ordered in one task; entities of more than `most` are cut into ranges of their order.
    Fixes that are equal in all of `order` may come either way.
    """
    counts = fixes.groupBy(F.col(entity).alias("_many")).agg(F.count("*").alias("_fixes")).where(F.col("_fixes") > most)
    if not counts.head(1):
        return _paired(fixes, [entity], order, lat, lon)
    many = gated(counts.select("_many"))
    same = fixes[entity].eqNullSafe(F.col("_many"))
    few = _paired(fixes.join(many, same, "left_anti"), [entity], order, lat, lon)
    return few.unionByName(_paired_by_range(fixes.join(many, same, "left_semi"), entity, order, lat, lon))


def _with_previous(fixes: DataFrame, keys: Sequence[str], order: Sequence[str], lat: str, lon: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return fixes.withColumns({"prev_lat": F.lag(lat).over(w), "prev_lon": F.lag(lon).over(w)})


def _paired(fixes: DataFrame, keys: Sequence[str], order: Sequence[str], lat: str, lon: str) -> DataFrame:
    return _with_previous(fixes, keys, order, lat, lon).where("prev_lat is not null and prev_lon is not null")


def _paired_by_range(fixes: DataFrame, entity: str, order: Sequence[str], lat: str, lon: str) -> DataFrame:
    """Order ranges of (entity, order) on their own; the first fix of each follows the last one of the range before.

    The table of last fixes has a row for each range of an entity.
    """
    ranged = fixes.repartitionByRange(entity, *order).withColumn("_part", F.spark_partition_id())
    last = ranged.groupBy(F.col(entity).alias("_entity"), "_part").agg(F.max_by(F.struct(lat, lon), F.struct(*order)).alias("_last"))
    before = Window.partitionBy("_entity").orderBy("_part")
    edges = last.select("_entity", F.col("_part").alias("_edge"), F.lag("_last").over(before).alias("_before"))
    own = _with_previous(ranged.withColumn("_first", F.row_number().over(Window.partitionBy(entity, "_part").orderBy(*order)) == 1), [entity, "_part"], order, lat, lon)
    joined = own.join(F.broadcast(edges), own[entity].eqNullSafe(F.col("_entity")) & (F.col("_part") == F.col("_edge")) & F.col("_first"), "left")
    whole = joined.withColumns({"prev_lat": F.when(F.col("_first"), F.col("_before")[lat]).otherwise(F.col("prev_lat")), "prev_lon": F.when(F.col("_first"), F.col("_before")[lon]).otherwise(F.col("prev_lon"))})
    return whole.where("prev_lat is not null and prev_lon is not null").drop("_part", "_entity", "_edge", "_before", "_first")
