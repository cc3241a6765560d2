"""Per-gap predictors (P1-P4): mean fallback, a tree ensemble or a linear model.

A predictor turns a DataFrame with the base features and prior-gap columns into
one prediction column, by JVM expressions alone. Everything it holds is model-sized
(statistics, medians, a node table or weights), never data-sized.

A set of predictors is stored as a version folder that is written whole and then
published by a pointer (S6), so a reader (S7) gets one version or another, never a mix.
"""

from __future__ import annotations

import datetime as _dt
import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (DEFAULT_GAP_MAX, DEFAULT_GAP_MEAN, DEFAULT_GAP_MIN, GAPS)
from ..functions.columns import clamp_round
from ..sources.tables import latest_run, path_exists, publish
from .ridge import Linear
from .trees import NODE_SCHEMA, Ensemble, load_forests


def _num(v, default):
    if v is None:
        return default
    try:
        f = float(v)
    except (TypeError, ValueError):
        return default
    return default if f != f else f


@dataclass
class GapPredictor:
    gap: str
    kind: str = "mean_fallback"          # or GradientBoosting / RandomForest / Ridge
    mean: float | None = None
    min: float | None = None
    max: float | None = None
    n: int = 0
    features: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    model: Ensemble | Linear | None = None

    # P2 / P3 / P4 defaults for missing statistics
    @property
    def mean_or_default(self) -> float:
        return _num(self.mean, DEFAULT_GAP_MEAN)

    @property
    def lo(self) -> float:
        return _num(self.min, DEFAULT_GAP_MIN)

    @property
    def hi(self) -> float:
        return _num(self.max, DEFAULT_GAP_MAX)

    @property
    def k(self) -> int:
        return GAPS.index(self.gap)

    def predict(self, df: DataFrame, priors: dict[str, Column], out: str, need: Column | None = None) -> DataFrame:
        """Add ``out``: the predicted days of this gap for every row of ``df``.

        ``priors`` maps each prior gap name to its value column (actual or
        predicted); a NULL prior is the mean of *this* gap (P2). A model is asked only for
        the rows where ``need`` holds; the others have NULL.
        """
        if self.model is None:
            # The mean itself, neither rounded nor clamped
            return df.withColumn(out, F.lit(self.mean_or_default))
        x = self.inputs({**{f: F.col(f) for f in self.features if f not in priors},
                         **{p: F.coalesce(c, F.lit(self.mean_or_default)) for p, c in priors.items()}})
        days = clamp_round(F.col("__raw"), F.lit(self.lo), F.lit(self.hi))
        return self.model.predicted(df, x, "__raw") \
            .withColumn(out, days if need is None else F.when(need, days)).drop("__raw")

    def inputs(self, values: dict[str, Column]) -> Column:
        """The model's features; one that is missing takes its training median (M2)."""
        return F.array(*[
            F.coalesce(values[f].cast("double"), F.lit(float(self.medians[f]))) for f in self.features])

    # -- persistence (S6 / S7) ---------------------------------------------
    def meta(self) -> dict:
        out = {"gap": self.gap, "kind": self.kind, "mean": self.mean, "min": self.min,
               "max": self.max, "n": self.n, "features": self.features,
               "medians": self.medians}
        if isinstance(self.model, Linear):
            out |= {"weights": self.model.weights, "intercept": self.model.intercept}
        elif self.model is not None:
            out |= {"base": self.model.base, "scale": self.model.scale}
        return out

    @classmethod
    def from_meta(cls, m: dict, nodes: list[tuple]) -> GapPredictor:
        model = None
        if "weights" in m:
            model = Linear(m["weights"], m["intercept"])
        elif "scale" in m:
            model = Ensemble(nodes, m["base"], m["scale"])
        return cls(gap=m["gap"], kind=m["kind"], mean=m["mean"], min=m["min"], max=m["max"],
                   n=m["n"], features=m["features"], medians=m["medians"], model=model)


# tables saved next to the predictors (S6): durations, label codes, scores, gap statistics
TABLES = ["durations", "railway_codes", "division_codes", "scores", "gap_stats"]


class ModelSet:
    """The six gap predictors plus the tables the forecast needs."""

    def __init__(self, predictors: list[GapPredictor], durations: DataFrame | None = None,
                 railway_codes: DataFrame | None = None, division_codes: DataFrame | None = None,
                 scores: DataFrame | None = None, with_objections: bool = False,
                 gap_stats: DataFrame | None = None):
        self.predictors = predictors
        self.gap_stats = gap_stats
        self.durations = durations
        self.railway_codes = railway_codes
        self.division_codes = division_codes
        self.scores = scores
        self.with_objections = with_objections
        self.version: str | None = None  # of a stored set

    def __getitem__(self, k: int) -> GapPredictor:
        return self.predictors[k]

    @property
    def needs_features(self) -> bool:
        """Mean predictors ignore the features, so a mean-only set skips building them."""
        return any(p.model is not None for p in self.predictors)

    def spread(self, df: DataFrame) -> DataFrame:
        """``df`` dealt over more tasks where large ensembles walk its rows: a row then costs far more
        than its bytes, by which files are cut into tasks."""
        spark = df.sparkSession
        if not load_forests([p.model for p in self.predictors], spark):
            return df
        return df.repartition(max(spark.sparkContext.defaultParallelism,
                                  int(spark.conf.get("spark.sql.shuffle.partitions"))))

    @classmethod
    def mean_only(cls, stats_rows: list, **tables) -> ModelSet:
        by_gap = {r["gap"]: r for r in stats_rows}
        preds = []
        for g in GAPS:
            r = by_gap.get(g)
            preds.append(GapPredictor(gap=g, mean=r["mean"] if r else None,
                                      min=r["min"] if r else None, max=r["max"] if r else None,
                                      n=int(r["n"]) if r else 0))
        return cls(preds, **tables)

    # Predictors (node tables + json metadata) and tables as parquet
    def save(self, path: str, version: str | None = None,
             extra: Callable[[str], None] | None = None) -> str:
        """Write a version folder under ``path``, publish it and return its folder.

        ``extra`` may write further files (the report) into the folder before it is published.
        """
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        version = version or f"{_dt.datetime.now():%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"
        folder = f"{path.rstrip('/')}/run={version}"
        nodes = [(p.gap, *n) for p in self.predictors if isinstance(p.model, Ensemble)
                 for n in p.model.nodes]
        spark.createDataFrame(nodes, f"gap string, {NODE_SCHEMA}").write.mode("overwrite") \
            .parquet(os.path.join(folder, "nodes"))
        for name in TABLES:
            df = getattr(self, name)
            if df is not None:
                df.write.mode("overwrite").parquet(os.path.join(folder, name))
        meta = {"with_objections": self.with_objections,
                "predictors": [p.meta() for p in self.predictors]}
        # written through Spark so the path may live on any Hadoop file system
        spark.createDataFrame([(json.dumps(meta),)], "meta string") \
            .coalesce(1).write.mode("overwrite").text(os.path.join(folder, "meta"))
        if extra is not None:
            extra(folder)
        publish(spark, path, version)
        self.version = version
        return folder

    # S7
    @classmethod
    def load(cls, spark, path: str, version: str | None = None) -> ModelSet:
        """The published set, or the given version of it; ``version`` says which one it is."""
        folder = f"{path.rstrip('/')}/run={version}" if version else latest_run(spark, path)
        if folder is None:
            raise FileNotFoundError(f"no model set is published under {path}")
        meta = json.loads(spark.read.text(os.path.join(folder, "meta")).first()[0])
        nodes: dict[str, list[tuple]] = {}
        for r in spark.read.parquet(os.path.join(folder, "nodes")).collect():  # model-sized
            nodes.setdefault(r[0], []).append(tuple(r)[1:])
        preds = [GapPredictor.from_meta(m, nodes.get(m["gap"], [])) for m in meta["predictors"]]
        tables = {}
        for name in TABLES:
            at = os.path.join(folder, name)
            tables[name] = spark.read.parquet(at) if path_exists(spark, at) else None
        out = cls(preds, with_objections=meta["with_objections"], **tables)
        out.version = folder.rsplit("run=", 1)[1]
        return out
