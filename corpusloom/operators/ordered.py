"""Neighbour and position operators that never gather one whole group in one task.

A plain ``lag`` over ``partitionBy(group)`` sends a group holding a third of all rows to a
single task. Here all rows are put in the order of group and order column by one range
partitioning, which cuts a large group wherever the sampled quantiles fall, and stored;
windows run inside its partitions only. What crosses a border - the last row, or a sum - is
carried by a table of one row per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Order values of one block, for callers that cut groups themselves.
BLOCK = 4096


def _in_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` sorted, with its partition (``_part``) and a number that grows with the order (``_at``); stored, so both stay."""
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ordered")


def with_previous(df: DataFrame, group: list[str], order: str, values: list[str], alias: str) -> DataFrame:
    """Add ``alias``: a struct of ``values`` on the preceding row of the group (NULL on the first row)."""
    rows = _in_order(df, [*group, order])
    packed = F.struct(F.struct(*group).alias("g"), F.struct(*values).alias("v"))
    inside = F.lag(packed).over(Window.partitionBy("_part").orderBy("_at"))
    tails = rows.groupBy("_part").agg(F.max_by(packed, "_at").alias("_tail"))
    borders = tails.select("_part", F.lag("_tail").over(Window.orderBy("_part")).alias("_border"))
    joined = rows.withColumn("_in", inside).join(borders, "_part", "left")
    before = joined.withColumn("_before", F.coalesce("_in", "_border"))
    same = F.col("_before.g").eqNullSafe(F.struct(*group))
    return before.withColumn(alias, F.when(same, F.col("_before.v"))).drop("_part", "_at", "_in", "_border", "_before")


def with_next(df: DataFrame, group: list[str], order: str, values: list[str], alias: str) -> DataFrame:
    """Like :func:`with_previous` for the following row."""
    flipped = df.withColumn("_neg", -F.col(order))
    return with_previous(flipped, group, "_neg", values, alias).drop("_neg")


def drop_consecutive(df: DataFrame, group: list[str], order: str, values: list[str]) -> DataFrame:
    """Keep the first row of every run of rows with equal values."""
    marked = with_previous(df, group, order, values, "_before")
    same = F.col("_before").isNotNull()
    for v in values:
        same = same & F.col("_before")[v].eqNullSafe(F.col(v))
    return marked.filter(~same).drop("_before")


def with_running_start(df: DataFrame, order: str, amount: str, alias: str) -> DataFrame:
    """Add ``alias``: the total of ``amount`` over all rows with a smaller ``order``."""
    rows = _in_order(df, [order])

    def exclusive(value: str, w):
        total = F.sum(F.col(value).cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(total, F.lit(0).cast("bigint"))

    totals = rows.groupBy("_part").agg(F.sum(amount).cast("bigint").alias("_n"))
    starts = totals.select("_part", exclusive("_n", Window.orderBy("_part")).alias("_s"))
    inside = rows.withColumn("_i", exclusive(amount, Window.partitionBy("_part").orderBy("_at")))
    return inside.join(starts, "_part").withColumn(alias, F.col("_i") + F.col("_s")).drop("_part", "_at", "_i", "_s")
