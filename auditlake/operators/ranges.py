"""Values of the row before, for groups that are too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def with_previous(rows: DataFrame, by: str, order: str, columns: list[str], parts: int, name: str = "previous") -> DataFrame:
    """rows with a struct of the ``columns`` of the row before in the group ``by``, in the order of ``order``; null for the first.

    Rows are split into ``parts`` ranges of group and order, so a group of any size uses many tasks. Within a range the row
    before comes from a window; the first row of a range takes the last one of the ranges before, of which there is one
    row for each group in each range. The split is written down before it is used twice. Rows with equal order are in no order.
    """
    placed = written(rows.repartitionByRange(parts, by, order).withColumn("_part", F.spark_partition_id()), "ranges")
    value = F.struct(*columns)
    last = placed.groupBy("_part", by).agg(F.max_by(value, order).alias("_last"))
    carried = last.select("_part", F.col(by).alias("_by"), F.lag("_last").over(Window.partitionBy(by).orderBy("_part")).alias("_carried"))
    inside = placed.withColumn(name, F.lag(value).over(Window.partitionBy("_part", by).orderBy(order))).withColumnRenamed("_part", "_own")
    joined = inside.join(carried, (F.col("_own") == F.col("_part")) & F.col(by).eqNullSafe(F.col("_by")), "left")
    return joined.withColumn(name, F.coalesce(name, "_carried")).drop("_own", "_part", "_by", "_carried")
