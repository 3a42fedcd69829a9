"""Rows in global order, cut into blocks that Spark's range partitioning balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def ordered_blocks(rows: DataFrame, keys: list, what: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``block``: all rows of a block come before those of the next one in the order of ``keys``.

    The cuts are Spark's own (sampled quantiles of the keys), so a block is near an equal share of the rows; only rows
    that agree in all keys must share one. The table is stored: block numbers stay the same when a task is run again.
    """
    ranged = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    return stored(ranged.withColumn("block", F.spark_partition_id()), what)


def carried(tails: DataFrame, value: str) -> DataFrame:
    """(block, before): the latest ``value`` that is not null among earlier blocks; ``tails`` has one row per block."""
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return tails.select("block", F.last(value, ignorenulls=True).over(earlier).alias("before"))


def ordered_rows(rows: DataFrame, keys: list, what: str) -> DataFrame:
    """``rows`` sorted by ``keys``, with ``block`` and ``at``: a number that grows with the order, by one inside a block."""
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(ranged.withColumns({"block": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), what)
