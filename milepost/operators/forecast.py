"""Forecast of the remaining milestone dates of every active project.

The chained per-project loop of the original service becomes six column steps
over the whole DataFrame: step k predicts gap k for every row (one model
``transform``), and rows whose current stage is at or before k take the
prediction, advance their running date and feed the value to later gaps.
No shuffle is added: the chain is row-local.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import GAPS, STAGE_COLS, STAGES
from .features import build_features, with_dates, with_gaps
from .models import ModelSet


def active_projects(master: DataFrame) -> DataFrame:
    """Rows with a 37A date and no mutation date (dates parsed first)."""
    d = with_dates(master)
    return d.where(F.col("date_37A").isNotNull() & F.col("mutation_date").isNull())


def current_stage_cols() -> dict[str, Column]:
    """Highest-index stage with a date (holes allowed) and that date."""
    idx = F.greatest(*[F.when(F.col(c).isNotNull(), F.lit(i)) for i, c in enumerate(STAGE_COLS)])
    date = F.coalesce(*[F.col(c) for c in reversed(STAGE_COLS)])
    return {"current_idx": F.coalesce(idx, F.lit(0)).cast("int"), "current_date": date}


def with_current_stage(df: DataFrame) -> DataFrame:
    cols = current_stage_cols()
    return df.select("*", *[v.alias(k) for k, v in cols.items()]) \
        .withColumn("current_stage", F.element_at(F.array(*[F.lit(s) for s in STAGES]),
                                                  F.col("current_idx") + 1))


def chain(df: DataFrame, models: ModelSet, start_idx: str, start_date: str,
          known_gap: dict[int, Column] | None = None) -> DataFrame:
    """Walk the six gaps forward from ``start_idx``.

    Adds ``days_k`` (prediction or NULL when not predicted) and ``date_k1``
    (predicted date of stage k+1 or NULL) for k = 0..5. ``known_gap`` gives the
    actual gap columns used as priors below the start stage (P7); a missing one
    is replaced by the mean of the gap being predicted (P2).
    """
    known_gap = known_gap or {}
    running = F.col(start_date)
    d = df
    for k, g in enumerate(GAPS):
        priors = {GAPS[j]: F.col(f"__v{j}") for j in range(k)}
        need = F.col(start_idx) <= F.lit(k)
        d = models[k].predict(d, priors, f"__pred{k}", need)
        value = F.when(need, F.col(f"__pred{k}")).otherwise(known_gap.get(k, F.lit(None)))
        new_running = F.when(need, F.date_add(running, F.col(f"__pred{k}").cast("int")))
        d = d.select("*", value.cast("double").alias(f"__v{k}"),
                     F.when(need, F.col(f"__pred{k}")).alias(f"days_{k}"),
                     new_running.alias(f"date_{k + 1}"))
        running = F.coalesce(F.col(f"date_{k + 1}"), running)
    return d.drop(*[f"__pred{k}" for k in range(6)], *[f"__v{k}" for k in range(6)])


def forecast(master: DataFrame, models: ModelSet, consistent: bool = False) -> DataFrame:
    """One row per active master row with the seven (actual or predicted) dates.

    Columns: project_id, current_stage, current_idx, current_date, the seven
    stage date columns and ``predicted_<stage>`` flags.
    """
    act = active_projects(master)
    if models.needs_features:
        feats = build_features(models.spread(act), "project", models.railway_codes, models.division_codes,
                               models.scores, models.with_objections, consistent)
    else:
        feats = with_gaps(act)
    d = with_current_stage(feats)
    actual = {k: F.col(g) for k, g in enumerate(GAPS)}
    d = chain(d, models, "current_idx", "current_date", actual)
    out = [F.col("project_id"), F.col("current_stage"), F.col("current_idx"),
           F.col("current_date"), F.col("date_37A")]
    for k in range(6):
        col = STAGE_COLS[k + 1]
        out.append(F.coalesce(F.col(f"date_{k + 1}"), F.col(col)).alias(col))
    for k in range(6):
        out.append(F.col(f"date_{k + 1}").isNotNull().alias(f"predicted_{STAGES[k + 1]}"))
    return d.select(*out)


def forecast_long(fc: DataFrame) -> DataFrame:
    """Forecast table in long form: (project_id, stage_idx, stage, stage_date)."""
    items = [F.struct(F.lit(i).alias("stage_idx"), F.lit(s).alias("stage"),
                      F.col(c).alias("stage_date")) for i, (s, c) in
             enumerate(zip(STAGES, STAGE_COLS))]
    return fc.select("project_id", F.inline(F.array(*items)))


__all__ = ["active_projects", "with_current_stage", "chain", "forecast", "forecast_long",
           "with_gaps"]
