"""Gap and stage-duration statistics.

Each statistic is one aggregate over the training rows; the gaps are unpivoted
into (gap, value) rows so that all six gaps share one pass and one small shuffle
(six groups, each pre-aggregated map-side; exact percentiles keep their
per-group buffers, which hold the values of one gap).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import GAPS, STAGES
from ..functions.quantiles import grouped_medians


def _long_gaps(df: DataFrame) -> DataFrame:
    return (df.select(*[F.col(g).cast("double").alias(g) for g in GAPS])
            .unpivot([], GAPS, "gap", "value")
            .where(F.col("value").isNotNull()))


def gap_stats(df: DataFrame) -> DataFrame:
    """Mean, sample std, min, max and n of every gap over its non-null rows.

    Every gap has a row; a gap without rows has NULL statistics and n = 0.
    """
    agg = _long_gaps(df).groupBy("gap").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.count(F.lit(1)).alias("n"))
    keys = df.sparkSession.createDataFrame([(i, g) for i, g in enumerate(GAPS)], "gap_idx int, gap string")
    return (keys.join(agg, "gap", "left")
            .select("gap_idx", "gap", "mean", "std", "min", "max",
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def prior_medians(df: DataFrame) -> DataFrame:
    """A2: exact median of every prior gap within the rows where the target gap is known.

    One aggregate over all (target, prior) pairs: rows (gap k known) x (prior j < k).
    """
    groups = {g: (F.col(g).isNotNull(), GAPS[:k]) for k, g in enumerate(GAPS) if k}
    return grouped_medians(df, groups).select(
        F.col("group").alias("gap"), F.col("column").alias("prior"), "median")


def stage_durations(df: DataFrame) -> DataFrame:
    """A3-A5: days from 37A to each later stage over rows where every gap up to it is known.

    Columns: stage, lognorm_mu, lognorm_sigma, min, max, p25, p50, p75, mean, std, n.
    ``ln(total + 1)`` is NULL for totals <= -1, so such rows leave the lognormal
    fit only.
    """
    totals = []
    running = None
    for k, stage in enumerate(STAGES[1:]):
        running = F.col(GAPS[k]) if running is None else running + F.col(GAPS[k])
        totals.append(F.struct(F.lit(stage).alias("stage"), F.lit(k + 1).alias("stage_idx"),
                               running.cast("double").alias("t")))
    long = (df.select(F.explode(F.array(*totals)).alias("s")).select("s.*")
            .where(F.col("t").isNotNull()))
    ln = F.ln(F.col("t") + 1)
    q = F.percentile(F.col("t"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (long.groupBy("stage_idx", "stage")
            .agg(F.avg(ln).alias("lognorm_mu"), F.stddev_samp(ln).alias("lognorm_sigma"),
                 F.min("t").alias("min"), F.max("t").alias("max"), q.alias("q"),
                 F.avg("t").alias("mean"), F.stddev_samp("t").alias("std"),
                 F.count(F.lit(1)).alias("n"))
            .select("stage_idx", "stage", "lognorm_mu", "lognorm_sigma", "min", "max",
                    F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"),
                    F.col("q")[2].alias("p75"), "mean", "std", "n"))


def summary_stats(df: DataFrame) -> DataFrame:
    """A1 and A3-A5 in one aggregate (one scan of the training rows).

    Rows ``kind = 'gap'`` (idx 0..5: mean, std, min, max, n) and ``kind = 'stage'``
    (idx 1..6: the stage durations with lognormal fit and quartiles); twelve rows
    at most, so the mean predictors and the duration table can travel as values.
    """
    items = [F.struct(F.lit("gap").alias("kind"), F.lit(k).alias("idx"), F.lit(g).alias("name"),
                      F.col(g).cast("double").alias("v")) for k, g in enumerate(GAPS)]
    running = None
    for k, stage in enumerate(STAGES[1:]):
        running = F.col(GAPS[k]) if running is None else running + F.col(GAPS[k])
        items.append(F.struct(F.lit("stage").alias("kind"), F.lit(k + 1).alias("idx"),
                              F.lit(stage).alias("name"), running.cast("double").alias("v")))
    long = df.select(F.inline(F.array(*items))).where(F.col("v").isNotNull())
    ln = F.ln(F.col("v") + 1)
    q = F.percentile(F.col("v"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (long.groupBy("kind", "idx", "name")
            .agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
                 F.min("v").alias("min"), F.max("v").alias("max"),
                 F.count(F.lit(1)).alias("n"), F.avg(ln).alias("lognorm_mu"),
                 F.stddev_samp(ln).alias("lognorm_sigma"), q.alias("q")))
