"""The three calls of the original service, as table-in / table-out functions.

* ``health``            -> one row: status and the number of active projects
* ``predict_stages``    -> one JSON response per request (Task 1)
* ``pipeline_snapshot`` -> one JSON response per target date text (Task 2)

Each call is one Spark job over any number of inputs; there is no server.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DATE_TEXT_FORMAT
from ..operators.models import ModelSet
from ..operators.scoring import decode_requests, envelope, score_requests
from ..operators.snapshot import snapshot, snapshot_from_counts, snapshot_response

BAD_DATE = "Invalid date. Use DD-MM-YYYY"


def health(forecast: DataFrame) -> DataFrame:
    """Status row with the active-project count (rows of the stored forecast)."""
    return forecast.agg(F.count(F.lit(1)).alias("active_projects")) \
        .select(F.lit("ok").alias("status"), "active_projects")


def predict_stages(requests: DataFrame, models: ModelSet, as_of=None) -> DataFrame:
    """Task 1: ``requests`` has ``request_id`` and a JSON ``body``; returns
    (request_id, success, response) with the JSON response text."""
    req = decode_requests(requests, body_col="body", as_of=as_of)
    return envelope(score_requests(req, models)).select("request_id", "success", "response")


def pipeline_snapshot(forecast: DataFrame | None, target_texts: DataFrame, models: ModelSet,
                      column: str = "target_date", counts: DataFrame | None = None) -> DataFrame:
    """Task 2: ``target_texts`` holds ``dd-mm-yyyy`` texts; returns
    (target_input, success, response). A text that is not a date gets the error
    envelope; every valid date is answered by one snapshot job, from the stored
    per-(stage, day) ``counts`` when given, else from the forecast."""
    t = target_texts.select(F.col(column).alias("target_input"),
                            F.try_to_date(F.col(column), DATE_TEXT_FORMAT).alias("target_date"))
    if counts is not None:
        snap = snapshot_from_counts(counts, t, models.durations)
    else:
        snap = snapshot(forecast, t, models.durations)
    good = snapshot_response(snap).join(t.where(F.col("target_date").isNotNull()), "target_date") \
        .select("target_input", F.lit(True).alias("success"), "response")
    bad = t.where(F.col("target_date").isNull()).select(
        "target_input", F.lit(False).alias("success"),
        F.to_json(F.struct(F.lit(False).alias("success"), F.lit(BAD_DATE).alias("error")))
        .alias("response"))
    return good.unionByName(bad)
