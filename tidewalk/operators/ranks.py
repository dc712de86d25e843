"""Places of all rows of a table in one order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewalk.sources.shared import cut


def global_rank(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with its place (from 1) in a total order: ranked within ranges of it, plus the rows of the ranges before; no task sees all rows."""
    dealt = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(offsets, "_range").withColumn(name, (within + F.col("_before")).cast("long")).drop("_range", "_before")
