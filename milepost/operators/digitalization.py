"""State digitalization scores.

The score table is dimension sized (one row per state); it is built from a state
dimension (code, name, fallback score) and optional live records
(order, state name, completion percentage as text or number).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..constants import DEFAULT_DIGITALIZATION, FALLBACK_DIGITALIZATION, STATE_NAME_TO_CODE
from ..functions.columns import strip

STATE_DIM_SCHEMA = StructType([StructField("state_code", IntegerType()),
                               StructField("state_name", StringType()),
                               StructField("fallback_score", DoubleType())])


def default_state_dim(spark: SparkSession) -> DataFrame:
    """Fixed state names, codes and fallback scores as one dimension table."""
    names = {v: k for k, v in STATE_NAME_TO_CODE.items()}
    codes = sorted(set(names) | set(FALLBACK_DIGITALIZATION))
    rows = [(c, names.get(c), FALLBACK_DIGITALIZATION.get(c)) for c in codes]
    return spark.createDataFrame(rows, STATE_DIM_SCHEMA)


# the field that carries the percentage in the live payload (fixed value)
PERCENT_FIELD = "no__of_villages_where_clr_completed____"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Live records (ord, state_ut, pct_completed) from the published payload.

    The file is one JSON object whose ``records`` array holds objects with ``state_ut`` and
    the percentage field; ``ord`` is the place in the array. The percentage is read as text
    so that a malformed value can be told from a missing one.
    """
    record = StructType([StructField("state_ut", StringType()), StructField(PERCENT_FIELD, StringType())])
    body = StructType([StructField("records", ArrayType(record))])
    return (spark.read.schema(body).option("multiLine", True).json(path)
            .select(F.posexplode("records").alias("ord", "r"))
            .select("ord", F.col("r.state_ut").alias("state_ut"),
                    F.col(f"r.{PERCENT_FIELD}").alias("pct_completed")))


def digitalization_scores(state_dim: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(state_code, score).

    A live record overrides the fallback of the state whose name equals the
    stripped record name; the last record (by ``ord``) wins. A missing percentage
    skips the record; any malformed percentage on a mapped record drops every
    live score (the whole fallback is used).
    """
    dim = state_dim.select("state_code", "state_name", "fallback_score")
    if records is None:
        return dim.where(F.col("fallback_score").isNotNull()) \
            .select("state_code", F.col("fallback_score").alias("score"))
    names = dim.where(F.col("state_name").isNotNull() & F.col("state_code").isNotNull()
                      & (F.col("state_code") != 0)) \
        .select(F.col("state_name").alias("name"), F.col("state_code").alias("code"))
    rec = records.select("ord", strip(F.col("state_ut").cast("string")).alias("name"),
                         F.col("pct_completed").cast("string").alias("pct")) \
        .where(F.col("pct").isNotNull())
    mapped = rec.join(names, "name") \
        .withColumn("val", F.col("pct").try_cast("double"))
    live = mapped.groupBy("code").agg(
        F.max_by(F.bround(F.col("val") / 100, 4), F.coalesce(F.col("ord"), F.lit(-1))).alias("live"),
        F.max(F.col("val").isNull().cast("int")).alias("bad"))
    any_bad = F.coalesce(live.agg(F.max("bad").alias("bad")).scalar(), F.lit(0))
    j = dim.join(live.drop("bad"), dim.state_code == live.code, "full")
    out = j.select(F.coalesce("state_code", "code").alias("state_code"),
                   F.when(any_bad == 1, F.col("fallback_score"))
                   .otherwise(F.coalesce("live", "fallback_score")).alias("score"))
    return out.where(F.col("score").isNotNull())


def add_digitalization(df: DataFrame, scores: DataFrame, state_col: str = "primary_state",
                       default: float = DEFAULT_DIGITALIZATION) -> DataFrame:
    """Score by primary state (default 0.70) and delay = 1 - score."""
    s = scores.select(F.col("state_code").cast("bigint").alias("__sc"),
                      F.col("score").alias("__score"))
    out = df.join(s, F.col(state_col).cast("bigint") == F.col("__sc"), "left")
    return (out.withColumn("digitalization_score",
                           F.coalesce(F.col("__score"), F.lit(default)).cast("double"))
            .withColumn("digitalization_delay", F.lit(1.0) - F.col("digitalization_score"))
            .drop("__sc", "__score"))
