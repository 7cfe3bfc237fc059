"""Values of the row before, running sums and fills over a whole ordered table, without one task holding it.

Rows are grouped in blocks of consecutive ordinals. Windows run inside blocks; what a block needs from the blocks before it
comes from a table with one row per block (and key), joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ordinals of a block.
BLOCK = 1 << 16


def _block(order: str, block: int) -> Column:
    return F.floor(F.col(order) / block).cast("long")


def previous(df: DataFrame, value: Column, name: str, order: str = "rec", keys: list[str] = (), block: int = BLOCK) -> DataFrame:
    """df with `name`: a struct of `v`, the value of the row before (null struct for the first row of a key)."""
    keys = list(keys)
    d = df.withColumn("__v", F.struct(value.alias("v"))).withColumn("__b", _block(order, block))
    edge = d.groupBy(*keys, "__b").agg(F.max_by("__v", order).alias("__last"))
    before = F.lag("__last").over(Window.partitionBy(*keys).orderBy("__b"))
    edge = edge.select(*keys, "__b", before.alias("__before"))
    inside = F.lag("__v").over(Window.partitionBy(*keys, "__b").orderBy(order))
    d = d.withColumn("__in", inside).join(edge, [*keys, "__b"])
    return d.withColumn(name, F.coalesce("__in", "__before")).drop("__v", "__b", "__in", "__before")


def running_sum(df: DataFrame, value: Column, name: str, order: list[str], keys: list[str] = (), block: int = BLOCK, inclusive: bool = True) -> DataFrame:
    """df with `name`: the sum of value over all rows of the key up to this one (or up to the one before it)."""
    keys = list(keys)
    d = df.withColumn("__v", value).withColumn("__b", _block(order[0], block))
    edge = d.groupBy(*keys, "__b").agg(F.sum("__v").alias("__s"))
    upto = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(*keys, "__b", F.coalesce(F.sum("__s").over(upto), F.lit(0)).alias("__before"))
    w = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    d = d.withColumn("__in", F.coalesce(F.sum("__v").over(w), F.lit(0))).join(edge, [*keys, "__b"])
    return d.withColumn(name, F.col("__in") + F.col("__before")).drop("__v", "__b", "__in", "__before")


def filled(df: DataFrame, value: Column, name: str, order: str = "rec", keys: list[str] = (), block: int = BLOCK) -> DataFrame:
    """df with `name`: the last value that is not null, up to this row."""
    keys = list(keys)
    d = df.withColumn("__v", value).withColumn("__b", _block(order, block))
    edge = d.where(F.col("__v").isNotNull()).groupBy(*keys, "__b").agg(F.max_by("__v", order).alias("__last"))
    edge = d.select(*keys, "__b").distinct().join(edge, [*keys, "__b"], "left")
    upto = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(*keys, "__b", F.last("__last", ignorenulls=True).over(upto).alias("__before"))
    w = Window.partitionBy(*keys, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__in", F.last("__v", ignorenulls=True).over(w)).join(edge, [*keys, "__b"])
    return d.withColumn(name, F.coalesce("__in", "__before")).drop("__v", "__b", "__in", "__before")
