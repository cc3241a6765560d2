"""Label codes (F3) and safe lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

NULL_LABEL = "nan"          # a missing category is its own class, as in the source data frames


def label_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NULL_LABEL))


def fit_label_codes(df: DataFrame, column: str, partitions: int | None = None) -> DataFrame:
    """F3 for one column: (label, code); see ``fit_label_codes_many``."""
    return fit_label_codes_many(df, [column], partitions)[column]


def fit_label_codes_many(df: DataFrame, columns: list[str],
                         partitions: int | None = None) -> dict[str, DataFrame]:
    """per column, (label, code) where code is the rank of the label among the
    sorted distinct labels of that column.

    Sorting is binary (``CSTM`` < ``Corporate Office``). All columns share one
    distinct pass and one range sort, and the rank needs no global window: the
    (column, label) pairs are range-partitioned and sorted, the sorted table is
    written once (so the range boundaries are fixed), every partition numbers its
    rows per column, and a per-(column, partition) offset is added; the offset
    table has one row per column and partition, not per label.
    """
    items = [F.struct(F.lit(c).alias("column"), label_of(F.col(c)).alias("label"))
             for c in columns]
    labels = df.select(F.inline(F.array(*items))).distinct()
    # without a fixed count AQE may merge neighbouring ranges, which keeps their order
    ranged = (labels.repartitionByRange(partitions, "column", "label") if partitions
              else labels.repartitionByRange("column", "label"))
    ordered = cut_lineage(ranged.sortWithinPartitions("column", "label")
                          .withColumn("pid", F.spark_partition_id()))
    local = ordered.withColumn(
        "local", F.row_number().over(Window.partitionBy("column", "pid").orderBy("label")) - 1)
    sizes = ordered.groupBy("column", "pid").agg(F.count(F.lit(1)).alias("cnt"))
    offsets = sizes.select(
        "column", "pid",
        (F.sum("cnt").over(Window.partitionBy("column").orderBy("pid")) - F.col("cnt"))
        .alias("start"))
    # written once: the planner then knows the size of the table and picks the join of a lookup
    codes = cut_lineage(local.join(F.broadcast(offsets), ["column", "pid"]).select(
        "column", "label", (F.col("start") + F.col("local")).cast("int").alias("code")))
    return {c: codes.where(F.col("column") == c).select("label", "code") for c in columns}


def encode(df: DataFrame, column: str, codes: DataFrame, out: str,
           unseen: int = 0) -> DataFrame:
    """replace ``column`` by its code; unseen labels get ``unseen`` (0)."""
    key = f"__{out}_label"
    d = df.withColumn(key, label_of(F.col(column)))
    c = codes.select(F.col("label").alias(key), F.col("code").alias(out))
    return d.join(c, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(unseen))) \
        .drop(key)
