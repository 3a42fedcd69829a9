"""Keep-first de-duplication and stable distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: list, order: list, k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key.

    The rank filter sits directly on the window, so every map task forwards at
    most ``k`` rows per key and a key holding many rows stays cheap.
    """
    cols = list(df.columns)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).select(*cols)


def keep_first(df: DataFrame, key: list[Column | str], order: list) -> DataFrame:
    cols = list(df.columns)
    named = {f"_k{i}": (F.col(c) if isinstance(c, str) else c) for i, c in enumerate(key)}
    return top_per_key(df.withColumns(named), list(named), order).select(*cols)


def prefix_key(chars: int, *columns: str, text: str = "text") -> list[Column]:
    """Columns plus the first characters of the text."""
    return [F.coalesce(F.col(c), F.lit("")) for c in columns] + [F.substring(F.col(text), 1, chars)]


def distinct_ignoring_case(values: Column) -> Column:
    """First spelling of every string of an array, in order."""
    def seen(acc: Column, x: Column) -> Column:
        return F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x))

    return F.aggregate(values, F.array().cast("array<string>"), seen)
