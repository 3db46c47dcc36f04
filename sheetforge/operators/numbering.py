"""Gapless numbers for rows in a global order, dealt in two steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetforge.scratch import stored


def numbered(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """``df`` plus ``name``: first, first + 1, ... in the order of ``order``, as long.

    Rows are cut into ranges of the order, stored once with their range, and numbered by their rank in the range behind the counts of the
    ranges before it; so no task orders all rows, and ranks and counts are of the same ranges. Rows that tie get any order.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = stored(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))  # one row for each range
    return ranged.withColumn("_rank", rank).join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_rank") + F.lit(first - 1)).cast("long").alias(name))
