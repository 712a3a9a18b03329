"""Row numbers that stay parallel when one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace


def global_positions(ws: Workspace, df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Adds the 0-based position of each row in the order of ``order``.

    The rows are range-partitioned and written once, so partition numbers are
    fixed; a position is the rank inside the partition plus the sizes of the
    partitions before it. Include a tie-breaking column so that equal sort keys
    spread over several partitions.
    """
    sorted_rows = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id())
    fixed = ws.cut(sorted_rows, "positions")
    inside = Window.partitionBy("__part").orderBy(*order)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (fixed.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
               .select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before")))
    numbered = fixed.withColumn("__inside", F.row_number().over(inside) - 1)
    # One row per partition: the offsets are always small.
    return (numbered.join(F.broadcast(offsets), "__part")
            .withColumn(name, F.col("__before") + F.col("__inside")).drop("__part", "__inside", "__before"))


def group_ranks(ws: Workspace, df: DataFrame, groups: Sequence[str], order: Sequence[str],
                name: str = "rank") -> DataFrame:
    """Adds the 0-based rank of each row in its group.

    The whole table is ranked by range partitions and each group subtracts its
    first position, so no task sees a whole group.
    """
    placed = global_positions(ws, df, [*groups, *order], "__position")
    if not groups:
        return placed.withColumnRenamed("__position", name)
    starts = placed.groupBy(*groups).agg(F.min("__position").alias("__start"))
    return (placed.join(starts, list(groups)).withColumn(name, F.col("__position") - F.col("__start"))
            .drop("__position", "__start"))


def running_total(df: DataFrame, groups: Sequence[str], chunk: Column, order: Sequence[str], weight: str,
                  name: str) -> DataFrame:
    """Adds the sum of ``weight`` over the rows before each row of its group.

    ``chunk`` splits every group into parts; rows are summed inside a part and
    the part totals give the offset, so no task sees a whole group. The order of
    the rows is (chunk, order).
    """
    df = df.withColumn("__chunk", chunk)
    inside = (Window.partitionBy(*groups, "__chunk").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    before = Window.partitionBy(*groups).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    offsets = (df.groupBy(*groups, "__chunk").agg(F.sum(weight).alias("__weight"))
               .select(*groups, "__chunk", F.coalesce(F.sum("__weight").over(before), zero).alias("__before")))
    return (df.withColumn("__inside", F.coalesce(F.sum(weight).over(inside), zero))
            .join(offsets, [*groups, "__chunk"])
            .withColumn(name, F.col("__before") + F.col("__inside"))
            .drop("__chunk", "__inside", "__before"))
