"""Size-balanced sharding by sampled splitters.

Records are ordered by (text hash, id, row), so equal texts lie side by side and a
group of copies is cut only where a shard ends. The order is never sorted as a
whole: a size-weighted sample gives quantile splitters, every record finds its range
by a binary search over the splitters, ranges that turn out overfull are split again
from a sample of their own, and exact running sums inside the ranges plus the
prefix sums of the range totals place each record.

Defined results: a null text has size 1 and crc32 0; empty texts count 1 byte;
repeated rows are separate records; null ids are kept; an empty table gives an empty
result. Only the id and text columns are read, so other columns can't clash. No shard
differs from total/n_shards by more than the size of one record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SAMPLES_PER_RANGE = 32
MIN_RANGES = 256
ROWS_PER_RANGE = 500_000
OVERFULL = 2.0


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Slim records (doc_id, size, text_crc32, key) with a unique sortable key, written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hexed = lambda c: F.lpad(F.hex(c), 16, "0")
    return cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.concat(hexed(F.xxhash64(text)),
                 hexed(F.coalesce(F.col(id_col).cast("long"), F.lit(0))),
                 hexed(F.monotonically_increasing_id())).alias("key")))


def range_of(key, splitters: list[str]):
    """Number of splitters <= key, by binary search over a literal array."""
    if not splitters:
        return F.lit(0)
    bounds = F.lit(splitters)
    steps = [1 << b for b in reversed(range(len(splitters).bit_length()))]
    return F.aggregate(
        F.lit(steps), F.lit(0),
        lambda lo, step: F.when(F.get(bounds, lo + step - 1) <= key, lo + step).otherwise(lo))


def _quantiles(rows: DataFrame, weight: float, per_range: float) -> list[str]:
    """Keys that cut a size-weighted Poisson sample of ``rows`` into equal weights.

    A row is drawn with probability min(1, size / weight) and stands for
    max(size, weight) bytes. ``per_range`` is the bytes a range should hold.
    """
    draw = F.pmod(F.xxhash64("key", F.lit("splitters")), F.lit(1 << 30)) / float(1 << 30)
    sample = (rows.filter(draw < F.col("size") / weight)
              .select("key", F.greatest(F.col("size").cast("double"), F.lit(weight)).alias("w")))
    before = F.sum("w").over(Window.orderBy("key")) - F.col("w")
    cut = sample.select("key", F.floor(before / per_range).alias("q"))
    return sorted(r.key for r in cut.groupBy("q").agg(F.min("key").alias("key"))
                  .filter("q > 0").collect())


def splitters(rows: DataFrame, total: int, n_ranges: int) -> list[str]:
    """Splitters for ``n_ranges`` ranges of about equal bytes.

    Ranges above ``OVERFULL`` times their share are sampled again and subdivided
    until none of several records is left; keys are unique, so this ends.
    """
    share = max(1.0, total / n_ranges)
    cuts = _quantiles(rows, max(1.0, share / SAMPLES_PER_RANGE), share)
    while True:
        ranged = rows.withColumn("range_id", range_of(F.col("key"), cuts))
        full = (ranged.groupBy("range_id").agg(F.sum("size").alias("b"), F.count("*").alias("n"),
                                               F.max("size").alias("top"))
                .filter(f"n > 1 and b - top > {OVERFULL * share}").select("range_id").collect())
        if not full:
            return cuts
        inside = ranged.filter(F.col("range_id").isin([r.range_id for r in full]))
        more = _quantiles(inside, max(1.0, share / SAMPLES_PER_RANGE / 4), share / 2)
        if not set(more) - set(cuts):
            return cuts
        cuts = sorted(set(cuts) | set(more))


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, law ``bytes``."""
    rows = records(docs, id_col, text_col)
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    cuts = splitters(rows, total, max(MIN_RANGES, -(-n // ROWS_PER_RANGE)))
    ranged = rows.withColumn("range_id", range_of(F.col("key"), cuts))

    # one row per range: prefix sums over at most n_ranges rows
    totals = ranged.groupBy("range_id").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("range_id",
                           F.coalesce(F.sum("b").over(before), F.lit(0)).alias("start_bytes"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start_rows"))
    inside = Window.partitionBy("range_id").orderBy("key")
    placed = (ranged.join(F.broadcast(starts), "range_id")
              .withColumn("end", F.col("start_bytes") + F.sum("size").over(
                  inside.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("rank", F.col("start_rows") + F.row_number().over(inside) - 1))
    # the middle of the record decides, in whole numbers
    middle = F.lit(2) * F.col("end") - F.col("size")
    which = F.expr(f"least({n_shards - 1}, ({n_shards}L * middle) div {2 * max(total, 1)}L)")
    placed = cut_lineage(placed.withColumn("middle", middle).select(
        "doc_id", "size", "text_crc32", which.cast("int").alias("shard"), "rank"))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op7_size_shards(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
