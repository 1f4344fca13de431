"""Ranks and running sums over a total order of any number of rows.

Rows are dealt into ranges of the order by a sampled range exchange and stored, so that ranges and the totals of ranges
agree. A task sees one range; only the totals, one row for each range, meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import durable

#: Bits of monotonically_increasing_id() that count within a partition.
_WITHIN = 33


def ranged(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows, stored, with _range and _at: both rise in the order, _at counts from 0 in each range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return durable(dealt.select("*", F.shiftright("_id", _WITHIN).alias("_range"), F.col("_id").bitwiseAND((1 << _WITHIN) - 1).alias("_at")).drop("_id"))


def _before(held: DataFrame, value: Column) -> DataFrame:
    """(_range, _base): the total of all ranges before each."""
    totals = held.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    return F.broadcast(totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base")))


def ordinals(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their rank in the order, from 1."""
    held = ranged(rows, order)
    return held.join(_before(held, F.lit(1)), "_range").select(*rows.columns, (F.col("_base") + F.col("_at") + 1).cast("bigint").alias(name))


def sums_before(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """rows with the sum of `value` over the rows before each in the order."""
    held = ranged(rows, order)
    within = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # one range
    out = held.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return out.join(_before(held, F.col(value)), "_range").select(*rows.columns, (F.col("_base") + F.col("_in")).cast("bigint").alias(name))
