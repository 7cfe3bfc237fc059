"""Change points, gaps and exceptions: regular columns apart from the few rows that differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.operators.ordered import filled, previous, running_sum


def change_points(df: DataFrame, value: Column, order: str = "rec", keys: list[str] = ()) -> DataFrame:
    """Rows (keys, order, value) at which the value differs from the row before; the first row always does."""
    d = previous(df.withColumn("__value", value), F.col("__value"), "__prev", order, keys)
    changed = F.col("__prev").isNull() | ~F.col("__prev.v").eqNullSafe(F.col("__value"))
    return d.where(changed).select(*keys, order, F.col("__value").alias("value"))


def gaps(df: DataFrame, order: str = "rec", keys: list[str] = ()) -> DataFrame:
    """df with `gap`: the ordinal less the one before it in the list, the first less 0."""
    d = previous(df, F.col(order), "__prev", order, keys)
    return d.withColumn("gap", (F.col(order) - F.coalesce("__prev.v", F.lit(0))).cast("long")).drop("__prev")


def ordinals(df: DataFrame, index: str = "idx", keys: list[str] = ()) -> DataFrame:
    """df with `ordinal`: the running sum of its gaps, which ends the list at a gap of 0 after the first."""
    return running_sum(df, F.col("gap"), "ordinal", [index], keys)


def replayed(df: DataFrame, changes: DataFrame, order: str = "rec", keys: list[str] = ()) -> DataFrame:
    """df with `value`: what the last change at or before the row set."""
    joined = df.join(changes.withColumnRenamed("value", "__value"), [*keys, order], "left")
    return filled(joined, F.col("__value"), "value", order, keys).drop("__value")


def exceptions(df: DataFrame, value: Column, expected: Column, order: str = "rec") -> DataFrame:
    """Rows (order, gap, value) whose value is not the expected one; not sticky."""
    return gaps(df.where(~value.eqNullSafe(expected)).select(order, value.alias("value")), order)
