"""End-to-end batch jobs: training and forecasting.

train:    sources -> master dataset -> snapshot (S4) -> features -> codes ->
          per-gap models -> artifacts (S6) + report (S8)
forecast: snapshot (S3) -> artifacts (S7) -> forecast table (P12) ->
          stage snapshot for any number of target dates (P13)
"""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoding import fit_label_codes_many
from ..operators.digitalization import default_state_dim, digitalization_scores
from ..operators.features import build_features, feature_names
from ..operators.forecast import forecast
from ..operators.master import master_dataset
from ..operators.models import ModelSet
from ..operators.snapshot import snapshot_from_counts, stage_day_counts
from ..operators.training import Preset, durations_report, train_all
from ..sources.tables import latest_run, publish, read_snapshot, write_snapshot
from .service import BAD_DATE


def fit_models(master: DataFrame, scores: DataFrame, preset: Preset | None = None,
               with_objections: bool = False):
    """Codes + features + per-gap models from a master dataset."""
    codes = fit_label_codes_many(master, ["railway", "division"])
    rc, dc = codes["railway"], codes["division"]
    feats = build_features(master, "train", rc, dc, scores, with_objections)
    return train_all(feats, rc, dc, scores, preset, with_objections)


def train_job(spark: SparkSession, sources: dict[str, DataFrame], snapshot_root: str,
              model_dir: str, preset: Preset | None = None, with_objections: bool = False,
              state_dim: DataFrame | None = None, records: DataFrame | None = None) -> DataFrame:
    """Build, snapshot and train; returns the report DataFrame."""
    path = write_snapshot(master_dataset(sources), snapshot_root)
    master = spark.read.parquet(path)
    scores = digitalization_scores(state_dim if state_dim is not None else default_state_dim(spark),
                                   records)
    models, report = fit_models(master, scores, preset, with_objections)
    models.save(model_dir, extra=lambda folder: write_report(
        spark, master, models, report, os.path.join(folder, "report")))
    return report


def write_report(spark, master: DataFrame, models: ModelSet, report: DataFrame, path: str):
    """One JSON document: rows, features, per-gap metrics, durations (4 places)."""
    gaps = {r["gap"]: {k: v for k, v in r.asDict().items() if k != "gap" and v is not None}
            for r in report.collect()}                      # six rows
    dur = {r["stage"]: {k: v for k, v in r.asDict().items() if k not in ("stage", "stage_idx")}
           for r in durations_report(models.durations).collect()}  # six rows
    doc = {"trained_on": datetime.now().strftime("%d-%m-%Y %H:%M:%S"),
           "dataset_rows": master.count(),
           "features": feature_names(models.with_objections),
           "objections_included": models.with_objections,
           "gap_models": gaps, "stage_durations": dur}
    spark.createDataFrame([(json.dumps(doc),)], "report string").coalesce(1) \
        .write.mode("overwrite").text(path)


def stored_forecast(spark: SparkSession, path: str) -> DataFrame:
    """The published forecast under ``path``."""
    return spark.read.parquet(f"{_published(spark, path)}/forecast")


def stored_counts(spark: SparkSession, path: str) -> DataFrame:
    """The per-(stage, day) counts that were published with the forecast."""
    return spark.read.parquet(f"{_published(spark, path)}/counts")


def _published(spark: SparkSession, path: str) -> str:
    folder = latest_run(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no forecast is published under {path}")
    return folder


def publish_forecast(fc: DataFrame, path: str, counts: DataFrame | None = None) -> str:
    """Write a forecast and its counts aside, then publish both at once.

    ``counts``: maintained counts of the same forecast (``incremental.merged_counts``); counted
    anew when not given.
    """
    spark = fc.sparkSession
    run = f"{datetime.now():%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"
    folder = f"{path.rstrip('/')}/run={run}"
    fc.write.parquet(f"{folder}/forecast")
    counts = stage_day_counts(spark.read.parquet(f"{folder}/forecast")) if counts is None else counts
    counts.write.parquet(f"{folder}/counts")
    publish(spark, path, run)
    return folder


def forecast_job(spark: SparkSession, snapshot_root: str, model_dir: str, out_path: str,
                 targets: DataFrame | None = None) -> DataFrame | None:
    """Forecast every active project once and store it (P12) together with its
    per-(stage, day) counts; snapshots are answered from the counts."""
    master = read_snapshot(spark, snapshot_root, with_runs=False)
    models = ModelSet.load(spark, model_dir)
    publish_forecast(forecast(master, models), out_path)
    if targets is None:
        return None
    return snapshot_from_counts(stored_counts(spark, out_path), targets, models.durations)


def stage_snapshot(spark: SparkSession, forecast_path: str, model_dir: str,
                   target_texts: list[str]) -> DataFrame:
    """P13 / P14 for dates given as ``dd-mm-yyyy`` text; bad texts get an error row."""
    from ..operators.snapshot import parse_targets
    models = ModelSet.load(spark, model_dir)
    t = parse_targets(spark.createDataFrame([(x,) for x in target_texts], "target_date string"))
    snap = snapshot_from_counts(stored_counts(spark, forecast_path), t, models.durations)
    bad = t.where(F.col("target_date").isNull()).select(F.col("target_input"), F.lit(BAD_DATE).alias("error"))
    return snap.unionByName(bad, allowMissingColumns=True)
