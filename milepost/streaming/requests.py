"""Task 1 as a Structured Streaming job.

Requests arrive as JSON lines ``{"request_id": ..., "body": "{...}"}`` in a
folder (or any streaming source with those two columns). Scoring is stateless:
decode -> features (stream-static joins against the code and score tables) ->
six model steps -> envelope, so no watermark or state store is needed and each
micro-batch is independent; the checkpoint location makes the sink exactly-once
across restarts.

``start_versioned_scoring`` follows a folder of published model sets: each micro-batch pins the
version that is published when it starts, so a retrain is picked up without a restart and no
batch is scored by a mix of two sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.models import ModelSet
from ..operators.scoring import decode_requests, envelope, score_requests

SOURCE_SCHEMA = "request_id long, body string"


def score_stream(requests: DataFrame, models: ModelSet, as_of=None) -> DataFrame:
    """Streaming (or batch) DataFrame of responses, one per request."""
    req = decode_requests(requests, body_col="body", as_of=as_of)
    return envelope(score_requests(req, models))


def start_request_scoring(spark: SparkSession, source_dir: str, sink_dir: str,
                          checkpoint_dir: str, models: ModelSet, as_of=None,
                          available_now: bool = False,
                          max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Read request files from ``source_dir`` and append responses to ``sink_dir`` (parquet)."""
    reader = spark.readStream.schema(SOURCE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    out = score_stream(reader.json(source_dir), models, as_of)
    writer = (out.writeStream.format("parquet").outputMode("append")
              .option("path", sink_dir).option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def start_versioned_scoring(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                            models_path: str, as_of=None, available_now: bool = False,
                            max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Score request files with the model set that is published when a micro-batch starts.

    A batch's responses are one folder ``<sink>/batch=<id>`` with the version that made them
    (``model_version``); a batch that is run again overwrites its folder.
    """
    def score(batch: DataFrame, batch_id: int) -> None:
        models = ModelSet.load(batch.sparkSession, models_path)
        (score_stream(batch, models, as_of).withColumn("model_version", F.lit(models.version))
         .write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch={batch_id}"))

    reader = spark.readStream.schema(SOURCE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    writer = reader.json(source_dir).writeStream.foreachBatch(score).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
