"""Spark side of every registered query: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import datetime as _dt
import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (BASE_FEATURES, CV_MAX_FOLDS, CV_ROWS_PER_FOLD, GAPS,
                         OBJECTION_FEATURES, STAGE_COLS)
from ..functions import columns as C
from ..functions.encoding import encode, fit_label_codes_many
from ..operators import master as M
from ..operators import scoring as S
from ..operators.digitalization import add_digitalization, digitalization_scores
from ..operators.features import build_features, own_features, with_dates, with_gaps
from ..operators.forecast import active_projects, forecast, with_current_stage
from ..operators.models import GapPredictor, ModelSet
from ..operators.snapshot import snapshot, snapshot_response
from ..operators.stats import gap_stats, prior_medians, stage_durations, summary_stats
from ..session import cut_lineage, keep_until_end, shared_dir
from ..operators.trees import Ensemble
from ..sources.fixtures import (FIXED_BASE, FIXED_MEDIAN, FIXED_SCALE, Fixtures, fixed_features,
                                fixed_nodes)
from ..sources.tables import latest_run

# request dates that do not parse fall back to this day (the service uses "today")
AS_OF = _dt.date(2025, 1, 1)
# target date of the single snapshot query
SNAPSHOT_DATE = _dt.date(1997, 6, 30)
DURATION_SCHEMA = ("stage_idx int, stage string, lognorm_mu double, lognorm_sigma double, "
                   "min double, max double, p25 double, p50 double, p75 double, mean double, "
                   "std double, n bigint")
FLOAT_FEATURES = ["government_land", "private_land", "forest_area", "land_difficulty_score",
                  "forest_proportion", "private_proportion", "govt_proportion",
                  "digitalization_score", "digitalization_delay"]

# master columns that the dates and gaps, the label codes and the features are made of
DATE_COLS = ["project_id", *STAGE_COLS]
LABEL_COLS = ["railway", "division"]
FEATURE_COLS = [*DATE_COLS, *LABEL_COLS, "states", "districts", "government_land", "private_land",
                "forest_area", "total_land", "court_case_count", "active_court_cases"]

Query = Callable[[SparkSession, str], DataFrame]


def _fx(spark: SparkSession, sf_dir: str) -> Fixtures:
    return Fixtures(spark, sf_dir)


def q_allocation_distinct(spark, sf_dir):
    return M.allocation_base(_fx(spark, sf_dir)["AllocationWise"])


def q_project_base(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return M.project_base(fx["project_basic"], fx["AllocationWise"])


def q_first_stage_dates(spark, sf_dir):
    return M.first_stage_dates_long(_fx(spark, sf_dir).sources())


def q_award_stage_dates(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return M.award_stage_dates(fx["nhai_award"], fx["nhai_award_det"])


def q_court_case_summary(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    out = M.court_case_summary(fx["court_case"], fx["court_case_details"])
    return out.withColumn("total_disputed_area", F.round("total_disputed_area", 6))


def q_objection_summary(spark, sf_dir):
    return M.objection_summary(_fx(spark, sf_dir)["three_A_objections"])


def q_master_dataset(spark, sf_dir):
    out = M.master_dataset(_fx(spark, sf_dir).sources(), ordered=True)
    return out.withColumn("total_disputed_area", F.round("total_disputed_area", 6))


# -- shared pieces ----------------------------------------------------------

class Ctx:
    """Per-call plan pieces (lazy DataFrames; nothing is computed until used)."""

    def __init__(self, spark, sf_dir, store: bool = True, columns: list[str] | None = None):
        self.spark = spark
        self.fx = Fixtures(spark, sf_dir)
        self.store = store
        self.columns = columns
        self._m = None
        self._codes = None
        self._scores = None

    @property
    def master(self):
        """The master dataset. A query that reads it more than once (codes, statistics
        and features) writes it once first, as the snapshot of S4 does; a query that
        reads it once keeps the plain plan (``store=False``). ``columns`` are those that
        the query reads: the others are not written, and Spark leaves out what only
        they need. Every row is there."""
        if self._m is None:
            dated = self.columns is None or any(c in self.columns for c in STAGE_COLS)
            m = M.master_dataset(self.fx.sources(dated))
            if self.columns is not None:
                m = m.select(*self.columns)
            self._m = cut_lineage(m) if self.store else m
        return self._m

    @property
    def rows(self):
        """Training rows: master with parsed dates and the six gaps."""
        return with_gaps(with_dates(self.master))

    @property
    def milestones(self):
        """Dates and gaps of every master row, without its other columns."""
        return with_gaps(with_dates(M.milestone_rows(self.fx.sources())))

    @property
    def codes(self):
        if self._codes is None:
            codes = fit_label_codes_many(self.master, ["railway", "division"])
            self._codes = (codes["railway"], codes["division"])
        return self._codes

    @property
    def scores(self):
        if self._scores is None:
            self._scores = cut_lineage(digitalization_scores(
                self.fx["state_dim"], self.fx["digitalization_records"]))
        return self._scores

    def features(self, df, mode, with_objections=False):
        rc, dc = self.codes
        return build_features(df, mode, rc, dc, self.scores, with_objections)

    def mean_models(self):
        """Mean predictors from one aggregate: six gap statistic rows and the six-row
        duration table (model-sized, so they travel as values); no codes or scores.

        They are stored (S6) the first time an application asks for those of a source
        folder and loaded (S7) afterwards, so a batch of requests reads no source table.
        """
        path = model_path(self, "mean")
        if latest_run(self.spark, path) is None:
            self._mean_models().save(path)
        return ModelSet.load(self.spark, path)

    def _mean_models(self):
        rows = self.milestones if self._m is None else self.rows
        rows = summary_stats(rows).collect()                 # twelve rows at most
        stats = [{"gap": r["name"], "mean": r["mean"], "min": r["min"], "max": r["max"],
                  "n": r["n"]} for r in rows if r["kind"] == "gap"]
        dur = [(r["idx"], r["name"], r["lognorm_mu"], r["lognorm_sigma"], r["min"], r["max"],
                r["q"][0], r["q"][1], r["q"][2], r["mean"], r["std"], r["n"])
               for r in rows if r["kind"] == "stage"]
        durations = self.spark.createDataFrame(dur, DURATION_SCHEMA)
        return ModelSet.mean_only(stats, durations=durations)

    def requests(self):
        return S.decode_requests(self.fx["requests"], rename={"current_date": "current_date_text"},
                                 as_of=AS_OF)


def _round(df, cols, nd=6):
    return df.select(*[F.round(F.col(c), nd).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


# -- F queries --------------------------------------------------------------

def q_parse_dates(spark, sf_dir):
    t = Fixtures(spark, sf_dir)["project_dates_text"]
    d = C.parse_date("date_37A")
    return t.select("project_id", F.col("date_37A").alias("date_text"), d.alias("parsed"),
                    C.format_date(d).alias("formatted"))


def q_stage_gaps(spark, sf_dir):
    return Ctx(spark, sf_dir).milestones.select("project_id", *GAPS)


def q_label_codes(spark, sf_dir):
    rc, dc = Ctx(spark, sf_dir, columns=LABEL_COLS).codes
    return rc.select(F.lit("railway").alias("column"), "label", "code").unionByName(
        dc.select(F.lit("division").alias("column"), "label", "code"))


def q_safe_encode(spark, sf_dir):
    c = Ctx(spark, sf_dir, columns=LABEL_COLS)
    rc, dc = c.codes
    r = c.fx["requests"].select("request_id", "railway", "division")
    r = encode(encode(r, "railway", rc, "railway_enc"), "division", dc, "division_enc")
    return r


def q_list_features(spark, sf_dir):
    m = Ctx(spark, sf_dir, store=False).master
    return m.select("project_id", "states", "districts",
                    C.first_token_int("states", 0).cast("bigint").alias("primary_state"),
                    C.first_token_int("districts", 0).cast("bigint").alias("primary_district"),
                    C.token_count("states", 1).alias("num_states"),
                    C.token_count("districts", 1).alias("num_districts"))


def q_digit_list_features(spark, sf_dir):
    r = Fixtures(spark, sf_dir)["requests"]
    return r.select("request_id", "states", "districts",
                    C.first_digit_token("states", 3).alias("primary_state"),
                    C.first_digit_token("districts", 27).alias("primary_district"),
                    C.digit_token_count("states").alias("num_states"),
                    C.digit_token_count("districts").alias("num_districts"))


LAND_OUT = ["government_land", "private_land", "forest_area", "court_case_count",
            "active_court_cases", "has_court_cases", "start_year", "start_month",
            "land_difficulty_score", "forest_proportion", "private_proportion",
            "govt_proportion"]


def q_land_features(spark, sf_dir):
    f = own_features(Ctx(spark, sf_dir, store=False).master, "train")
    return _round(f.select("project_id", *LAND_OUT), FLOAT_FEATURES)


def q_land_features_project(spark, sf_dir):
    f = own_features(active_projects(Ctx(spark, sf_dir, store=False).master), "project")
    return _round(f.select("project_id", *LAND_OUT), FLOAT_FEATURES)


def q_land_features_request(spark, sf_dir):
    f = own_features(Ctx(spark, sf_dir).requests(), "request")
    return _round(f.select("request_id", *LAND_OUT), FLOAT_FEATURES)


def q_digitalization_scores(spark, sf_dir):
    return _round(Ctx(spark, sf_dir).scores, ["score"])


def q_digitalization_features(spark, sf_dir):
    c = Ctx(spark, sf_dir, store=False)
    m = c.master.select("project_id", "states",
                        C.first_token_int("states", 0).cast("bigint").alias("primary_state"))
    return _round(add_digitalization(m, c.scores),
                  ["digitalization_score", "digitalization_delay"])


def q_training_features(spark, sf_dir, with_objections=False):
    c = Ctx(spark, sf_dir, columns=FEATURE_COLS + (OBJECTION_FEATURES if with_objections else []))
    f = c.features(c.master, "train", with_objections)
    feats = BASE_FEATURES + (OBJECTION_FEATURES if with_objections else [])
    return _round(f.select("project_id", *feats, *GAPS), FLOAT_FEATURES)


def q_training_features_obj(spark, sf_dir):
    return q_training_features(spark, sf_dir, with_objections=True)


# -- A queries --------------------------------------------------------------

def q_gap_stats(spark, sf_dir):
    return _round(gap_stats(Ctx(spark, sf_dir).milestones), ["mean", "std", "min", "max"])


def q_prior_medians(spark, sf_dir):
    return prior_medians(Ctx(spark, sf_dir).milestones)


def q_stage_durations(spark, sf_dir):
    d = stage_durations(Ctx(spark, sf_dir).milestones)
    return _round(d, ["lognorm_mu", "lognorm_sigma", "min", "max", "p25", "p50", "p75",
                      "mean", "std"])


def q_report_durations(spark, sf_dir):
    """The stage-duration block of the training report (values rounded to 4 places)."""
    from ..operators.training import durations_report
    return durations_report(stage_durations(Ctx(spark, sf_dir).milestones))


def q_active_projects(spark, sf_dir):
    a = active_projects(Ctx(spark, sf_dir, store=False).master)
    return a.select("project_id", "allocation_project_id", "division", "date_37A")


def q_health(spark, sf_dir):
    """A7 as the service's health call: status and the number of active projects."""
    from .service import health
    return health(active_projects(Ctx(spark, sf_dir, store=False).master))


def q_current_stage(spark, sf_dir):
    a = with_gaps(with_current_stage(active_projects(Ctx(spark, sf_dir, store=False).master)))
    return a.select("project_id", "current_idx", "current_stage", "current_date", *GAPS)


def q_clamp_round(spark, sf_dir):
    c = Ctx(spark, sf_dir, columns=DATE_COLS)
    st = gap_stats(c.rows).select("gap", "min", "max")
    long = c.rows.select("project_id", *GAPS).unpivot("project_id", GAPS, "gap", "g") \
        .where(F.col("g").isNotNull())
    j = long.join(F.broadcast(st), "gap")          # six stats rows
    pred = F.col("g") / 2.0
    return j.select("project_id", "gap", pred.alias("pred"),
                    C.clamp_round(pred, F.col("min"), F.col("max")).cast("int").alias("days"))


# -- P queries --------------------------------------------------------------

def q_forecast_mean(spark, sf_dir):
    c = Ctx(spark, sf_dir, columns=DATE_COLS)
    return forecast(c.master, c.mean_models())


def _targets(c):
    return c.fx["target_dates"]


def q_snapshot_mean(spark, sf_dir, target: _dt.date = SNAPSHOT_DATE):
    """The snapshot of a single request: its date is the parameter."""
    c = Ctx(spark, sf_dir, columns=DATE_COLS)
    m, mm = c.master, c.mean_models()
    one = spark.createDataFrame([(target,)], "target_date date")
    return snapshot(forecast(m, mm), one, mm.durations)


def q_snapshot_many_dates(spark, sf_dir):
    c = Ctx(spark, sf_dir, columns=DATE_COLS)
    m, mm = c.master, c.mean_models()      # the stored rows serve the models as well
    return snapshot(forecast(m, mm), _targets(c), mm.durations)


def q_snapshot_envelope(spark, sf_dir):
    """S10 for Task 2: one JSON response per target date."""
    return snapshot_response(q_snapshot_many_dates(spark, sf_dir))


def q_score_requests_mean(spark, sf_dir):
    c = Ctx(spark, sf_dir, store=False)
    return S.predictions_long(S.score_requests(c.requests(), c.mean_models()))


def q_request_envelope(spark, sf_dir):
    c = Ctx(spark, sf_dir, store=False)
    r = c.fx["requests"]
    body = F.to_json(F.struct(*[F.col(x).alias(x.removesuffix("_text")) for x in r.columns
                                if x != "request_id"]))
    req = S.decode_requests(r.select("request_id", body.alias("body")), body_col="body",
                            as_of=AS_OF)
    return S.envelope(S.score_requests(req, c.mean_models()))


def q_request_decoding(spark, sf_dir):
    """S9 / F16 / P14 on bodies with every kind of fault."""
    req = S.decode_requests(_fx(spark, sf_dir)["request_bodies"], body_col="body", as_of=AS_OF)
    return req.select("request_id", "error", "railway", "division", "states", "government_land",
                      "forest_area", "court_case_count", "active_court_cases")


# -- learned models (rows-only checks) ---------------------------------------

def model_path(c: Ctx, kind: str) -> str:
    """Folder of the stored models of a source folder, in this application's shared folder."""
    name = hashlib.sha256(c.fx.sf_dir.encode()).hexdigest()[:16]
    return keep_until_end(
        c.spark, f"{shared_dir(c.spark)}/models/{c.spark.sparkContext.applicationId}/{name}-{kind}")


def learned_models(c: Ctx):
    """The trained models and their report, loaded from the stored artifacts.

    They are trained at full size and stored (S6) under the shared folder the first time
    an application asks for the models of a source folder.
    """
    from ..operators.training import train_all
    spark = c.spark
    path = model_path(c, "learned")
    if latest_run(spark, path) is None:
        rc, dc = c.codes
        feats = build_features(c.master, "train", rc, dc, c.scores, False)
        models, report = train_all(feats, rc, dc, c.scores)
        models.save(path, extra=lambda folder: report.write.parquet(f"{folder}/report"))
    return ModelSet.load(spark, path), spark.read.parquet(f"{latest_run(spark, path)}/report")


def _fold_count():
    return F.greatest(F.least(F.lit(CV_MAX_FOLDS), F.floor(F.col("n") / CV_ROWS_PER_FOLD)), F.lit(1))


def q_cv_folds(spark, sf_dir):
    """M8: fold sizes of all gaps, from the folds that training deals out."""
    from ..operators.training import with_folds
    c = Ctx(spark, sf_dir)
    rows = cut_lineage(c.milestones.select("project_id", *GAPS))
    long = (rows.select("project_id", *GAPS).unpivot("project_id", GAPS, "gap", "v")
            .where(F.col("v").isNotNull()))
    n = long.groupBy("gap").agg(F.count(F.lit(1)).alias("n"))
    k = cut_lineage(n.select("gap", _fold_count().cast("int").alias("k")))  # six rows
    dealt = with_folds(long.join(F.broadcast(k), "gap"), F.col("k"), ["gap"])
    return dealt.groupBy("gap", "k", "fold").agg(F.count(F.lit(1)).alias("n_rows"))


def q_training_set_medians(spark, sf_dir):
    from ..operators.training import training_set_medians
    c = Ctx(spark, sf_dir, columns=FEATURE_COLS)
    return _round(training_set_medians(c.features(c.master, "train")), ["median"])


def _samples(c: Ctx):
    """M1 / M2: every gap's imputed training rows and the feature names by gap."""
    from ..operators.training import features_of, medians_by_gap, training_samples
    rows = c.features(c.master, "train").select("project_id", *BASE_FEATURES, *GAPS)
    rows = cut_lineage(rows)
    medians = medians_by_gap(rows)
    return training_samples(rows, medians), {g: features_of(g, m) for g, m in medians.items()}, medians


def q_scaled_features(spark, sf_dir):
    """M1-M3 of all six gaps: (gap, project_id, feature, value) of the imputed and scaled rows."""
    from ..operators.training import scaled_samples
    samples, names, _ = _samples(Ctx(spark, sf_dir, columns=FEATURE_COLS))
    label = F.create_map(*[F.lit(x) for i, g in enumerate(GAPS) for x in (i, g)])
    feature = F.create_map(*[y for i, g in enumerate(GAPS)
                             for y in (F.lit(i), F.array(*[F.lit(f) for f in names[g]]))])
    z = scaled_samples(samples).select("gap", "project_id", F.posexplode("x").alias("i", "v"))
    # + 0.0: a negative zero is zero
    return z.select(label[F.col("gap")].alias("gap"), "project_id",
                    F.get(feature[F.col("gap")], F.col("i")).alias("feature"),
                    (F.round("v", 4) + F.lit(0.0)).alias("value"))


RIDGE_FOLDS = 5


def q_ridge_cv(spark, sf_dir):
    """M6 / M9 from Gram sums: (gap, term, value) of every gap's ridge on all rows, with the mean
    held-out R^2 over the folds project_id mod 5."""
    from ..constants import RIDGE_ALPHA
    from ..operators.ridge import ridge_cv
    samples, names, medians = _samples(Ctx(spark, sf_dir, columns=FEATURE_COLS))
    samples = cut_lineage(samples.withColumn("fold", F.pmod("project_id", F.lit(RIDGE_FOLDS)).cast("int")))
    means = {r.gap: r.m for r in samples.groupBy("gap").agg(F.avg("y").alias("m")).collect()}
    shifts = {GAPS.index(g): [medians[g][f] for f in names[g]] + [means[GAPS.index(g)]]
              for g in GAPS if GAPS.index(g) in means}
    rows = []
    for i, cv in ridge_cv(samples, shifts, RIDGE_ALPHA).items():
        rows += [(GAPS[i], f, w) for f, w in zip(names[GAPS[i]], cv.model.weights)]
        rows += [(GAPS[i], "(intercept)", cv.model.intercept),
                 (GAPS[i], "(cv_r2)", sum(cv.scores.values()) / len(cv.scores))]
    return _round(spark.createDataFrame(rows, "gap string, term string, value double"), ["value"])


def q_model_metrics(spark, sf_dir):
    """R^2 and MAE of stored predictions (the gap's mean, the gap before) in one
    aggregate over the long table."""
    from ..operators.metrics import regression_metrics
    c = Ctx(spark, sf_dir, columns=DATE_COLS)
    means = {r["gap"]: r["mean"] for r in gap_stats(c.rows).collect()}     # six rows
    items = [F.struct(F.lit(g).alias("gap"), F.lit(p).alias("predictor"), F.col(g).cast("double").alias("y"),
                      v.cast("double").alias("pred"))
             for i, g in enumerate(GAPS)
             for p, v in (("mean", F.lit(means[g])), ("gap before", F.col(GAPS[i - 1]) if i else F.lit(30)))]
    stored = cut_lineage(c.rows.select(F.inline(F.array(*items))))
    out = regression_metrics(stored, ["gap", "predictor"])
    return out.select("gap", "predictor", "n", (F.round("r2", 6) + F.lit(0.0)).alias("r2"),
                      F.round("mae", 6).alias("mae"))


def fixed_models(c: Ctx):
    """The fixed ensembles with this data's statistics, stored (S6) and loaded again."""
    path = model_path(c, "fixed")
    if latest_run(c.spark, path) is None:
        rc, dc = c.codes
        stats = {r["gap"]: r for r in gap_stats(c.rows).collect()}         # six rows
        preds = []
        for k, g in enumerate(GAPS):
            names = fixed_features(k)
            preds.append(GapPredictor(
                gap=g, kind="GradientBoosting", mean=stats[g]["mean"], min=stats[g]["min"],
                max=stats[g]["max"], n=stats[g]["n"], features=names,
                medians={f: FIXED_MEDIAN for f in names},
                model=Ensemble(fixed_nodes(k), FIXED_BASE, FIXED_SCALE)))
        ModelSet(preds, railway_codes=rc, division_codes=dc, scores=c.scores).save(path)
    return ModelSet.load(c.spark, path)


def q_forecast_trees(spark, sf_dir):
    """P1, P2, P4, P9 with tree ensembles: the fixed node tables over every active project."""
    c = Ctx(spark, sf_dir, columns=FEATURE_COLS)
    return forecast(c.master, fixed_models(c))


def q_score_requests_trees(spark, sf_dir):
    """P10 with tree ensembles: predicted gaps feed the later ones, priors start empty."""
    c = Ctx(spark, sf_dir, columns=FEATURE_COLS)
    return S.predictions_long(S.score_requests(c.requests(), fixed_models(c)))


# -- refreshes, stores and faults ---------------------------------------------

def _scratch(spark, kind: str) -> str:
    """A fresh folder in the shared folder, deleted with the other tables."""
    return keep_until_end(spark, f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}")


def _sources_before(src):
    """Sources as they were before a day's changes, and the changed rows of each table."""
    before, changes = dict(src), {}
    pid = lambda m, r: F.pmod("project_id", F.lit(m)) == r
    late = pid(50, 7)                                           # notifications that came later
    before["notification_37A"] = src["notification_37A"].where(~late)
    changes["notification_37A"] = src["notification_37A"].where(late)
    edited = pid(50, 9)                                         # projects whose total was corrected
    before["project_basic"] = src["project_basic"].withColumn(
        "total_land", F.when(edited, F.col("total_land") + 1).otherwise(F.col("total_land")))
    changes["project_basic"] = before["project_basic"].where(edited).unionByName(
        src["project_basic"].where(edited))
    added = F.pmod("case_id", F.lit(40)) == 3                   # case details that were added
    before["court_case_details"] = src["court_case_details"].where(~added)
    changes["court_case_details"] = src["court_case_details"].where(added)
    paid = F.pmod("award_id", F.lit(40)) == 5                   # payments that were entered
    before["nhai_award_det"] = src["nhai_award_det"].withColumn(
        "payment_date", F.when(~paid, F.col("payment_date")))
    changes["nhai_award_det"] = src["nhai_award_det"].where(paid)
    gone = src["AllocationWise"].where(F.pmod("PROJECTID", F.lit(30)) == 4).withColumn("division", F.lit("OLD"))
    before["AllocationWise"] = src["AllocationWise"].unionByName(gone)      # allocations that were deleted
    changes["AllocationWise"] = gone
    return before, changes


def q_master_incremental(spark, sf_dir):
    """The master as it was, refreshed by the changed rows only."""
    from ..operators.incremental import read_master, refresh_master, write_master
    src = Fixtures(spark, sf_dir).sources()
    src["nhai_award"] = cut_lineage(src["nhai_award"])      # grouped once for the two builds and the ids
    before, changes = _sources_before(src)
    root = _scratch(spark, "master")
    write_master(M.master_dataset(before), root)
    refresh_master(src, changes, root)
    return read_master(spark, root).withColumn("total_disputed_area", F.round("total_disputed_area", 6))


def q_snapshot_maintained(spark, sf_dir):
    """Snapshots from counts that two refreshes kept up by signed rows."""
    from ..operators.incremental import count_deltas, merged_counts
    from ..operators.snapshot import snapshot_from_counts
    from .jobs import publish_forecast, stored_counts
    c = Ctx(spark, sf_dir, columns=DATE_COLS)
    m, mm = c.master, c.mean_models()
    edited, late = F.pmod("project_id", F.lit(9)) == 1, F.pmod("project_id", F.lit(13)) == 2
    # before: some 7A dates were missing, and some projects had not come yet
    was = m.where(~late).withColumn("date_7A", F.when(~edited, F.col("date_7A")))
    path = _scratch(spark, "forecasts")
    publish_forecast(forecast(was, mm), path)
    first = merged_counts(stored_counts(spark, path), count_deltas(
        forecast(was.where(edited), mm), forecast(m.where(edited & ~late), mm)))
    publish_forecast(forecast(m.where(~late), mm), path, first)
    nothing = forecast(was.limit(0), mm)
    second = merged_counts(stored_counts(spark, path), count_deltas(nothing, forecast(m.where(late), mm)))
    publish_forecast(forecast(m, mm), path, second)
    return snapshot_from_counts(stored_counts(spark, path), _targets(c), mm.durations)


def _merged_statistics(spark, sf_dir, kind: str):
    from ..operators.incremental import combined_states, statistic_states
    month = F.date_trunc("month", "date_37A").cast("date")
    rows = Ctx(spark, sf_dir).milestones.withColumn("part", month)
    states = cut_lineage(statistic_states(rows, ["part"]))     # stored, a few rows a month
    return combined_states(states).where(F.col("kind") == kind)


def q_gap_stats_merged(spark, sf_dir):
    """A1 / A6 from the stored states of every month."""
    out = _merged_statistics(spark, sf_dir, "gap").select(
        F.col("idx").alias("gap_idx"), F.col("name").alias("gap"), "mean", "std", "min", "max", "n")
    return _round(out, ["mean", "std", "min", "max"])


def q_stage_moments_merged(spark, sf_dir):
    """A3 / A4 from the stored states of every month."""
    cols = ["lognorm_mu", "lognorm_sigma", "min", "max", "mean", "std"]
    out = _merged_statistics(spark, sf_dir, "stage").select(
        F.col("idx").alias("stage_idx"), F.col("name").alias("stage"), *cols, "n")
    return _round(out, cols)


def q_master_round_trip(spark, sf_dir):
    """The master written as a run, published and read back."""
    from ..sources.tables import read_snapshot, write_snapshot
    root = _scratch(spark, "snapshots")
    write_snapshot(M.master_dataset(Fixtures(spark, sf_dir).sources()), root)
    return read_snapshot(spark, root).withColumn("total_disputed_area", F.round("total_disputed_area", 6))


def q_records_payload(spark, sf_dir):
    """The scores from the published payload's JSON file."""
    from ..operators.digitalization import PERCENT_FIELD, read_records
    fx = Fixtures(spark, sf_dir)
    record = F.struct("ord", "state_ut", F.col("pct_completed").alias(PERCENT_FIELD))
    body = fx["digitalization_records"].agg(F.array_sort(F.collect_list(record)).alias("records"))  # a row a state
    path = _scratch(spark, "payload")
    body.select(F.to_json(F.struct("records")).alias("value")).write.text(path)
    return _round(digitalization_scores(fx["state_dim"], read_records(spark, path)), ["score"])


def q_digitalization_faults(spark, sf_dir):
    """the last of repeated records counts; a malformed percentage turns all live scores off."""
    fx = Fixtures(spark, sf_dir)
    out = None
    for case in ("repeated", "malformed"):
        part = digitalization_scores(fx["state_dim"], fx[f"digitalization_{case}"]) \
            .select(F.lit(case).alias("records"), "state_code", "score")
        out = part if out is None else out.unionByName(part)
    return _round(out, ["score"])


def q_request_errors(spark, sf_dir):
    """The error envelopes of faulty request bodies."""
    c = Ctx(spark, sf_dir, store=False)
    req = S.decode_requests(c.fx["request_bodies"], body_col="body", as_of=AS_OF)
    out = S.envelope(S.score_requests(req, c.mean_models()))
    return out.where(~F.col("success")).select("request_id", "success", "error", "response")


def q_bad_target_dates(spark, sf_dir):
    """The error envelopes of target dates that are no dates."""
    from .service import pipeline_snapshot
    c = Ctx(spark, sf_dir, columns=DATE_COLS)
    m, mm = c.master, c.mean_models()
    texts = c.fx["project_dates_text"].select(F.col("date_37A").alias("target_date")).distinct()
    return pipeline_snapshot(forecast(m, mm), texts, mm).where(~F.col("success"))


# -- learned models -----------------------------------------------------------

def q_gap_model_report(spark, sf_dir):
    return learned_models(Ctx(spark, sf_dir, columns=FEATURE_COLS))[1]


def q_forecast_learned(spark, sf_dir):
    c = Ctx(spark, sf_dir, columns=FEATURE_COLS)
    return forecast(c.master, learned_models(c)[0])


def q_snapshot_learned(spark, sf_dir):
    c = Ctx(spark, sf_dir, columns=FEATURE_COLS)
    ms = learned_models(c)[0]
    return snapshot(forecast(c.master, ms), _targets(c), ms.durations)


def q_score_requests_learned(spark, sf_dir):
    c = Ctx(spark, sf_dir, columns=FEATURE_COLS)
    return S.predictions_long(S.score_requests(c.requests(), learned_models(c)[0]))


def queries() -> dict[str, Query]:
    return {
        "allocation_distinct": q_allocation_distinct,
        "project_base": q_project_base,
        "first_stage_dates": q_first_stage_dates,
        "award_stage_dates": q_award_stage_dates,
        "court_case_summary": q_court_case_summary,
        "objection_summary": q_objection_summary,
        "master_dataset": q_master_dataset,
        "parse_dates": q_parse_dates,
        "stage_gaps": q_stage_gaps,
        "label_codes": q_label_codes,
        "safe_encode": q_safe_encode,
        "list_features": q_list_features,
        "digit_list_features": q_digit_list_features,
        "land_features": q_land_features,
        "land_features_project": q_land_features_project,
        "land_features_request": q_land_features_request,
        "digitalization_scores": q_digitalization_scores,
        "digitalization_features": q_digitalization_features,
        "training_features": q_training_features,
        "training_features_obj": q_training_features_obj,
        "gap_stats": q_gap_stats,
        "prior_medians": q_prior_medians,
        "training_set_medians": q_training_set_medians,
        "scaled_features": q_scaled_features,
        "stage_durations": q_stage_durations,
        "report_durations": q_report_durations,
        "active_projects": q_active_projects,
        "health": q_health,
        "current_stage": q_current_stage,
        "clamp_round": q_clamp_round,
        "forecast_mean": q_forecast_mean,
        "snapshot_mean": q_snapshot_mean,
        "snapshot_many_dates": q_snapshot_many_dates,
        "snapshot_envelope": q_snapshot_envelope,
        "score_requests_mean": q_score_requests_mean,
        "request_envelope": q_request_envelope,
        "request_decoding": q_request_decoding,
        "cv_folds": q_cv_folds,
        "ridge_cv": q_ridge_cv,
        "model_metrics": q_model_metrics,
        "forecast_trees": q_forecast_trees,
        "score_requests_trees": q_score_requests_trees,
        "master_incremental": q_master_incremental,
        "snapshot_maintained": q_snapshot_maintained,
        "gap_stats_merged": q_gap_stats_merged,
        "stage_moments_merged": q_stage_moments_merged,
        "master_round_trip": q_master_round_trip,
        "records_payload": q_records_payload,
        "digitalization_faults": q_digitalization_faults,
        "request_errors": q_request_errors,
        "bad_target_dates": q_bad_target_dates,
        "gap_model_report": q_gap_model_report,
        "forecast_learned": q_forecast_learned,
        "snapshot_learned": q_snapshot_learned,
        "score_requests_learned": q_score_requests_learned,
    }
