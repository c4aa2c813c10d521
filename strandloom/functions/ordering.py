"""Places and neighbours along one order of a whole table, without a window that puts all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.lineage import checkpoint


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place (from 1) in an order of all rows; equal ones in any order.

    Rows are dealt out by ranges of the order, numbered in each range, and moved on by the sizes of the ranges
    before. The ranges come from a sample, so they are written before anything is counted in them. Only the sizes,
    a row per range, are summed up in one task and broadcast.
    """
    dealt = checkpoint(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.join(F.broadcast(sizes), "__range").withColumn(name, own + F.col("__before")).drop("__range", "__before")


def beside(rows: DataFrame, at: str, value: str, before: str, after: str, width: int = 4096) -> DataFrame:
    """Rows with a value of the rows one place before and after; ``at`` numbers rows without gaps, as ``numbered`` does.

    Windows are pieces of ``width`` places and one more at either side.
    """
    piece = lambda shift: F.floor((F.col(at) + shift) / width)
    spread = rows.withColumn("__piece", F.explode(F.array_distinct(F.array(piece(0), piece(-1), piece(1)))))
    along = Window.partitionBy("__piece").orderBy(at)
    found = spread.withColumns({before: F.lag(value).over(along), after: F.lead(value).over(along)})
    return found.where(F.col("__piece") == piece(0)).drop("__piece")
