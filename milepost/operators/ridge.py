"""Ridge regression from sufficient statistics (M6 with M9).

One aggregate gives the Gram sums of every (gap, fold): X'X, X'y, y'y and the count, by the
entries of one matrix over (features, label, 1), which a task multiplies up batch by batch. The sums of a gap less those of a fold are
the sums without the fold, so all fold models, the model on all rows and every held-out R^2
follow from one pass; only these sums (a few hundred numbers per gap and fold) reach the driver.
Features are shifted by a value near their middle first, so the sums lose no digits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .trees import linear


@dataclass
class Linear:
    """intercept + weights . x on unscaled features."""
    weights: list[float]
    intercept: float

    def column(self, x: Column) -> Column:
        return linear([F.get(x, i) for i in range(len(self.weights))], self.weights, self.intercept)

    def predicted(self, df: DataFrame, x: Column, out: str) -> DataFrame:
        return df.withColumn(out, self.column(x))


def _gram_parts(shifts: dict[int, np.ndarray]):
    """One task's sums: a matrix per (gap, fold), added up batch by batch."""
    def run(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            gaps, folds, y = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = b.column(3)
            for gap in np.unique(gaps):
                mine = np.flatnonzero(gaps == gap)
                wide = x.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), -1)
                z = np.column_stack([wide, y[mine]]) - shifts[int(gap)]
                z = np.column_stack([z, np.ones(len(mine))])
                for fold in np.unique(folds[mine]):
                    part = z[folds[mine] == fold]
                    key = int(gap), int(fold)
                    held[key] = held.get(key, 0.0) + part.T @ part
        rows = [(g, f, i, j, float(m[i, j])) for (g, f), m in held.items()
                for i in range(len(m)) for j in range(i, len(m))]
        if rows:
            kinds = [pa.int32()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                             names=["gap", "fold", "i", "j", "s"])
    return run


def gram_sums(samples: DataFrame, shifts: dict[int, list[float]]) -> DataFrame:
    """(gap, fold, i, j, s): sums of z_i z_j, i <= j, over z = (x - shift, y - shift, 1).

    ``samples``: gap, fold, y, x array; ``shifts``: gap -> shifts with the label's last. A task
    gives one matrix per gap and fold, whatever its rows; the matrices are added in a shuffle.
    """
    ship_package(samples.sparkSession, small_batches=False)
    held = {g: np.array(s, dtype=np.float64) for g, s in shifts.items()}
    return (samples.where(F.col("gap").isin(*held))
            .select(F.col("gap").cast("int"), F.col("fold").cast("int"), F.col("y").cast("double"), "x")
            .mapInArrow(_gram_parts(held), "gap int, fold int, i int, j int, s double")
            .groupBy("gap", "fold", "i", "j").agg(F.sum("s").alias("s")))


@dataclass
class Fit:
    """A fitted ridge in shifted coordinates."""
    weights: np.ndarray
    intercept: float


def solve(gram: np.ndarray, alpha: float) -> Fit:
    """Penalty ``alpha`` on features scaled to population deviation 1, free intercept."""
    p = len(gram) - 2
    n = gram[-1, -1]
    mean = gram[:-1, -1] / n
    cov = gram[:-1, :-1] / n - np.outer(mean, mean)
    var = np.diag(cov)[:p]
    flat = var <= 1e-14 * np.maximum(np.diag(gram)[:p] / n, 1e-300)  # a constant feature has no say
    sd = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, var)))
    xx, xy = cov[:p, :p] / np.outer(sd, sd), cov[:p, p] / sd
    xx[flat, :], xx[:, flat], xy[flat] = 0.0, 0.0, 0.0
    w = np.linalg.solve(xx * n + alpha * np.eye(p), xy * n) / sd
    return Fit(w, float(mean[p] - w @ mean[:p]))


def held_out_r2(gram: np.ndarray, fit: Fit) -> float:
    """R^2 of ``fit`` on the rows that ``gram`` sums up; NaN below two rows."""
    n = gram[-1, -1]
    if n < 2:
        return float("nan")
    v = np.concatenate([-fit.weights, [1.0, -fit.intercept]])
    sse = float(v @ gram @ v)
    sst = float(gram[-2, -2] - gram[-2, -1] ** 2 / n)
    if sst <= 0:
        return 1.0 if sse <= 0 else 0.0
    return 1.0 - sse / sst


@dataclass
class RidgeCV:
    """Cross-validation scores and the whole-data model of one gap."""
    scores: dict[int, float]
    model: Linear


def ridge_cv(samples: DataFrame, shifts: dict[int, list[float]], alpha: float) -> dict[int, RidgeCV]:
    """All gaps' fold scores and whole-data models from one aggregate."""
    grams: dict[int, dict[int, np.ndarray]] = {}
    for r in gram_sums(samples, shifts).collect():  # model-sized
        size = len(shifts[r.gap]) + 1
        g = grams.setdefault(r.gap, {}).setdefault(r.fold, np.zeros((size, size)))
        g[r.i, r.j] = g[r.j, r.i] = r.s
    out = {}
    for gap, folds in grams.items():
        total = sum(folds.values())
        scores = {f: held_out_r2(g, solve(total - g, alpha)) for f, g in folds.items()
                  if total[-1, -1] > g[-1, -1]}
        fit = solve(total, alpha)
        s = np.array(shifts[gap])
        out[gap] = RidgeCV(scores, Linear([float(w) for w in fit.weights],
                                          float(fit.intercept + s[-1] - fit.weights @ s[:-1])))
    return out
