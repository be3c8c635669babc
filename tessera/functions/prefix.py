"""Prefix sums over an order without a window that sees a whole partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(rows: DataFrame, keys: list[str], order: list[str], value: Column, into: str, width: int = 4096, inclusive: bool = True) -> DataFrame:
    """rows with ``into`` added: the sum of ``value`` up to the row, by key, in the given order.

    The first order column must be a number. Rows are cut into ranges of ``width`` of its values;
    totals of the ranges are a small table, and a window runs only inside a range. So one key
    with a third of all rows is worked on by as many tasks as it has ranges.
    """
    ranged = rows.withColumn("_range", F.floor(F.col(order[0]) / width)).withColumn("_value", value.cast("bigint"))
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = F.sum("_value").over(within)
    found = ranged.join(totals, [*keys, "_range"]).withColumn(into, F.col("_before") + (sums if inclusive else sums - F.col("_value")))
    return found.drop("_range", "_value", "_before")
