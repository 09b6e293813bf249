"""Dense ordinals and running totals over a whole table, without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut


def with_ordinals(df: DataFrame, out: str = "doc_id") -> DataFrame:
    """``df`` with dense numbers from 0 in its present order: positions in each partition, moved up by the rows of the
    partitions before. Only one count per partition is gathered."""
    numbered = cut(df.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.expr("__at >> 33")))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", before.alias("__before"))
    # as many rows as there are partitions
    joined = numbered.join(F.broadcast(starts), "__part")
    return joined.withColumn(out, F.expr("(__at & ((1L << 33) - 1)) + __before")).drop("__at", "__part", "__before")


def running_total(df: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before it in ``order`` (which must be total) as ``out``.

    Rows are range-partitioned by the order and summed in each partition, whose totals are carried on.
    """
    rows = df.withColumn("__v", F.coalesce(value.cast("bigint"), F.lit(0)))
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    spread = cut(spread)
    before = F.coalesce(F.sum("__t").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = spread.groupBy("__part").agg(F.sum("__v").alias("__t")).select("__part", before.alias("__carried"))
    inside = F.coalesce(F.sum("__v").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spread.withColumn("__in", inside).join(F.broadcast(totals), "__part").withColumn(out, F.col("__in") + F.col("__carried")).drop("__v", "__part", "__in", "__carried")
