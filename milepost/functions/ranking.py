"""Exact distributed rank: no task holds a whole group or the whole table.

Rows are range-partitioned and sorted by (group, order) and written once, so the range
borders are fixed; every partition numbers its rows and adds the number of rows of the same
group in the partitions before it. The table of starts has a row per group and partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

PID = "__pid"


def with_rank(df: DataFrame, order: list[str], group: list[str] | None = None,
              out: str = "rank", size: str | None = None) -> DataFrame:
    """``df`` plus ``out``: 0, 1, 2 ... within ``group`` in rising ``order`` (nulls first).

    Rows that are equal in ``order`` are numbered in any order. ``size`` adds the number
    of rows of the group. Null group values form a group of their own.
    """
    group = list(group or [])
    keys = [F.col(c) for c in [*group, *order]]
    rows = cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                       .withColumn(PID, F.spark_partition_id()))
    whole = Window.partitionBy(*[F.col(c) for c in group] or [F.lit(0)])  # a row per partition and group
    starts = (rows.groupBy(*group, PID).agg(F.count(F.lit(1)).alias("__n"))
              .select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)],
                      F.col(PID).alias("__p"), "__n",
                      (F.sum("__n").over(whole.orderBy(PID)) - F.col("__n")).alias("__start"),
                      F.sum("__n").over(whole).alias("__size")))
    same = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)]
    on = F.col(PID) == F.col("__p")
    for s in same:
        on = on & s
    local = Window.partitionBy(PID, *group).orderBy(*order)
    extra = [F.col("__size").alias(size)] if size else []
    return (rows.withColumn("__local", F.row_number().over(local) - 1)
            .join(F.broadcast(starts), on)
            .select(*df.columns, (F.col("__start") + F.col("__local")).alias(out), *extra))
