"""Places and running sums within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.shared import discard, staged


def running(rows: DataFrame, group: str, order: list[str], value: str, name: str, keep: list[str], before_it: bool = False) -> DataFrame:
    """``keep`` columns of ``rows`` with ``name``: the sum of ``value`` over the rows of the ``group`` up to each (or before it), in ``order``; a written table.

    Rows are dealt into ranges of group and order, so a group of any size is shared among tasks;
    what a group has in the ranges before is added. Groups that lie in several
    ranges are twice as many as there are ranges at most, so their sums are broadcast.
    """
    dealt = staged(rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range", group).agg(F.sum(value).alias("_sum"))
    split = sums.join(sums.groupBy(group).agg(F.count("*").alias("_n")).where("_n > 1").select(group), group, "left_semi")
    before = F.sum("_sum").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    split = staged(split.select("_range", group, F.coalesce(before, F.lit(0)).alias("_before")))
    within = F.sum(value).over(Window.partitionBy("_range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    led = dealt.withColumn("_within", within).join(F.broadcast(split), ["_range", group], "left")
    total = F.col("_within") + F.coalesce("_before", F.lit(0)) - (F.col(value) if before_it else F.lit(0))
    out = staged(led.select(*keep, total.alias(name)))
    discard(dealt, split)
    return out
