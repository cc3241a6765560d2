"""Ridge equals its closed form; snapshot equals brute-force counting; training falls back."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from milepost.constants import GAPS, STAGE_COLS
from milepost.operators.snapshot import snapshot
from milepost.operators.training import n_folds, train_gap, with_folds


def _ridge_closed_form(X, y, alpha):
    """Weights and intercept on population-standardised features, unpenalised intercept."""
    mu, sd = X.mean(axis=0), X.std(axis=0)
    Z = (X - mu) / sd
    w = np.linalg.solve(Z.T @ Z + alpha * np.eye(X.shape[1]), Z.T @ (y - y.mean())) / sd
    return w, y.mean() - w @ mu


def _r2(y, p):
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_ridge_cv_matches_closed_form(spark):
    from milepost.operators.ridge import ridge_cv
    rng = np.random.default_rng(7)
    alpha, rows, want = 10.0, [], {}
    for gap, (n, p) in enumerate(((300, 4), (90, 3))):
        X = rng.normal(size=(n, p)) * ([1.0, 3.0, 0.5, 10.0][:p]) + [0, 5, -2000, 1][:p]
        y = X @ [2.0, -1.0, 0.5, 0.1][:p] + rng.normal(size=n) * 2 + 1e6
        fold = np.arange(n) % 5
        rows += [(gap, int(f), float(v), [float(a) for a in x]) for x, v, f in zip(X, y, fold)]
        scores = {}
        for f in range(5):
            w, b = _ridge_closed_form(X[fold != f], y[fold != f], alpha)
            scores[f] = _r2(y[fold == f], X[fold == f] @ w + b)
        want[gap] = scores, _ridge_closed_form(X, y, alpha)
    df = spark.createDataFrame(rows, "gap int, fold int, y double, x array<double>").repartition(3)
    got = ridge_cv(df, {0: [0.0, 5.0, -2000.0, 1.0, 1e6], 1: [0.0, 5.0, -2000.0, 1e6]}, alpha)
    for gap, (scores, (w, b)) in want.items():
        assert got[gap].scores == pytest.approx(scores, abs=1e-9)
        assert got[gap].model.weights == pytest.approx(list(w), rel=1e-9, abs=1e-12)
        assert got[gap].model.intercept == pytest.approx(b, rel=1e-9)


def test_ridge_ignores_a_constant_feature(spark):
    from milepost.operators.ridge import ridge_cv
    rows = [(0, i % 2, 2.0 * i, [float(i), 7.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "gap int, fold int, y double, x array<double>")
    got = ridge_cv(df, {0: [20.0, 7.0, 40.0]}, 10.0)[0]
    assert got.model.weights[1] == 0.0 and all(s > 0.5 for s in got.scores.values())


def _samples(spark, n=1500, gaps=2, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(gaps):
        X = rng.normal(size=(n, 6 + g))
        X[:, 3] = rng.integers(0, 5, n)
        y = 50 + 10 * X[:, 0] + 5 * np.sin(3 * X[:, 1]) + 4 * (X[:, 3] > 2) * X[:, 4] + rng.normal(size=n) * 4
        rows += [(g, i, i % 3, float(y[i]), [float(v) for v in X[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "gap int, row bigint, fold int, y double, x array<double>")


def test_boosting_passes_agree(spark):
    """Level passes, in-memory subtrees and any partitioning grow the same trees."""
    from milepost.operators.boosting import Boost, boost
    df, folds, how = _samples(spark, 600), {0: 3, 1: 3}, Boost(rounds=12, depth=3)
    whole = boost(df, folds, how)
    level = boost(df.repartition(5), folds, how, small_node=0)
    mixed = boost(df.repartition(2), folds, how, small_node=150)
    for g in folds:
        assert whole.ensembles[g].nodes == level.ensembles[g].nodes == mixed.ensembles[g].nodes
    key = ["gap", "fold", "model", "y"]
    a, b = (f.predictions.toPandas().sort_values(key).pred.to_numpy() for f in (whole, level))
    assert np.allclose(a, b, atol=1e-9)
    # the running predictions are those of the node table
    e = whole.ensembles[1]
    table = df.where("gap = 1").select("y", e.column(F.col("x")).alias("p")).toPandas().sort_values("y")
    own = whole.predictions.where("gap = 1 and model = 3").toPandas().sort_values("y")
    assert np.allclose(table.p, own.pred, atol=1e-9)
    x = df.where("gap = 1").first()
    assert e.predict_one(x.x) == pytest.approx(table.p[table.y == x.y].iloc[0])


def test_small_gaps_grow_without_passes(spark, monkeypatch):
    """One gap in a task a model, the other in passes: the same trees as all in passes."""
    from milepost.operators import boosting
    df = _samples(spark, 400).where("gap = 0 or row < 300")
    folds, how = {0: 3, 1: 3}, boosting.Boost(rounds=6, depth=3)
    passes = boosting.boost(df, folds, how, whole_rows=0)
    some = boosting.boost(df, folds, how, whole_rows=300)

    def never(*_):
        raise AssertionError("a pass")
    monkeypatch.setattr(boosting, "_in_passes", never)
    every = boosting.boost(df, folds, how)
    key = ["gap", "fold", "model", "y"]
    a, b, c = (f.predictions.toPandas().sort_values(key).pred.to_numpy() for f in (passes, some, every))
    assert (a == b).all() and (a == c).all()
    for g in folds:
        assert passes.ensembles[g].nodes == some.ensembles[g].nodes == every.ensembles[g].nodes


def test_gram_sums_send_a_matrix_a_task(spark):
    from milepost.operators.ridge import gram_sums
    df = _samples(spark, 500).repartition(3)
    out = gram_sums(df, {0: [1.0] * 7, 1: [2.0] * 8})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    got = {(r.gap, r.fold, r.i, r.j): r.s for r in out.collect()}
    for g in (0, 1):
        for f in range(3):
            rows = df.where(f"gap = {g} and fold = {f}").collect()
            z = np.array([[*r.x, r.y] for r in rows]) - (g + 1)
            z = np.column_stack([z, np.ones(len(z))])
            m = z.T @ z
            assert all(got[g, f, i, j] == pytest.approx(m[i, j]) for i in range(len(m)) for j in range(i, len(m)))


def test_medians_count_a_value_once_for_all_groups(spark):
    from milepost.functions import quantiles
    df = spark.createDataFrame([(float(i % 7), None if i % 3 else float(i)) for i in range(50)], "a double, b double")
    groups = {"all": (F.lit(True), ["a", "b"]), "some": (F.col("b") > 10, ["a"]), "null": (F.lit(None).cast("boolean"), ["a"])}
    got = {(r.group, r.column): (r.median, r.n) for r in quantiles.grouped_medians(df, groups).collect()}
    rows = [(float(i % 7), None if i % 3 else float(i)) for i in range(50)]
    some = [a for a, b in rows if b is not None and b > 10]
    assert got == {("all", "a"): (np.median([a for a, _ in rows]), 50),
                   ("all", "b"): (np.median([b for _, b in rows if b is not None]), 17),
                   ("some", "a"): (np.median(some), len(some))}


def test_boosting_scores_as_spark_ml(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    from milepost.operators.boosting import Boost, boost
    df, rounds = _samples(spark, 1500, 1), 60
    own = boost(df, {0: 3}, Boost(rounds=rounds)).predictions.where("model = fold").toPandas()
    data = df.select("fold", "y", array_to_vector("x").alias("v")).coalesce(1).cache()
    ours, theirs = [], []
    for f in range(3):
        part = own[own.fold == f]
        ours.append(_r2(part.y.to_numpy(), part.pred.to_numpy()))
        m = GBTRegressor(featuresCol="v", labelCol="y", maxIter=rounds, stepSize=0.05, maxDepth=4,
                         minInstancesPerNode=5, subsamplingRate=0.8, seed=42).fit(data.where(F.col("fold") != f))
        p = m.transform(data.where(F.col("fold") == f)).toPandas()
        theirs.append(_r2(p.y.to_numpy(), p.prediction.to_numpy()))
    assert np.mean(ours) > np.mean(theirs) - 0.02 and np.mean(ours) > 0.6


def test_best_split_by_brute_force():
    from milepost.operators.boosting import BINS, _level_hist, best_splits
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, size=(80, 3)).astype(np.uint8)
    r = np.round(rng.normal(size=80) + (x[:, 1] > 2), 3)
    best, cuts = -1.0, None
    for f in range(3):
        for c in range(BINS - 1):
            left = x[:, f] <= c
            if min(left.sum(), (~left).sum()) >= 5:
                gain = sum(r[s].sum() ** 2 / s.sum() for s in (left, ~left)) - r.sum() ** 2 / len(r)
                if gain > best + 1e-9:
                    best, cuts = gain, (f, c)
    got = best_splits(_level_hist(x, np.zeros(80, np.int64), r, 1), 5)[0]
    assert (got["feature"], got["cut"]) == cuts
    assert got["left"] == pytest.approx(r[x[:, cuts[0]] <= cuts[1]].mean())


def test_forest_nodes_predict_as_the_forest(spark):
    from pyspark.ml.functions import array_to_vector

    from milepost.operators.training import _forest, forest_nodes
    data = _samples(spark, 400, 1).select("x", "y", array_to_vector("x").alias("v")).cache()
    model = _forest(dict(numTrees=7, maxDepth=4, minInstancesPerNode=5, featureSubsetStrategy="sqrt", seed=42), data)
    e = forest_nodes(model)
    got = model.transform(data).select("pred", e.column(F.col("x")).alias("p")).toPandas()
    assert np.allclose(got.pred, got.p, atol=1e-9) and e.depth() <= 4


def test_metrics_match_their_definition(spark):
    from milepost.operators.metrics import regression_metrics
    rng = np.random.default_rng(6)
    rows = [(int(g), 1e9 + float(a), 1e9 + float(a + e)) for g, a, e in zip(
        rng.integers(0, 3, 400), rng.normal(size=400), rng.normal(size=400) / 3)]
    rows += [(7, 1.0, 2.0), (8, 4.0, 4.0), (8, 4.0, 4.0), (9, 4.0, 5.0), (9, 4.0, 4.0), (0, None, 1.0), (0, 1.0, None)]
    got = {r.g: r for r in regression_metrics(
        spark.createDataFrame(rows, "g int, y double, pred double"), ["g"]).collect()}
    for g in range(3):
        y, p = (np.array([r[i] for r in rows if r[0] == g and None not in r]) for i in (1, 2))
        assert got[g].n == len(y) and got[g].mae == pytest.approx(np.abs(y - p).mean(), rel=1e-9)
        assert got[g].r2 == pytest.approx(_r2(y, p), rel=1e-6)
    assert got[7].r2 is None and got[8].r2 == 1.0 and got[9].r2 == 0.0


def test_snapshot_matches_brute_force(spark):
    random.seed(3)
    base = dt.date(2020, 1, 1)
    rows = []
    for pid in range(400):
        d = [base + dt.timedelta(days=random.randint(0, 900))]
        for _ in range(6):
            d.append(None if random.random() < 0.2 else d[-1] + dt.timedelta(days=random.randint(0, 200))
                     if d[-1] else None)
        rows.append((pid, *d))
    fc = spark.createDataFrame(rows, "project_id long, " + ", ".join(f"{c} date" for c in STAGE_COLS))
    targets = [base + dt.timedelta(days=x) for x in (-5, 0, 100, 365, 800, 2000)]
    tdf = spark.createDataFrame([(t,) for t in targets], "target_date date")
    got = {(r["target_date"], r["stage_idx"]): r for r in snapshot(fc, tdf).collect()}
    assert len(got) == len(targets) * 7
    for t in targets:
        for i in range(7):
            want = sum(1 for r in rows if r[1 + i] is not None and r[1 + i] <= t)
            g = got[(t, i)]
            assert g["projects_reached"] == want
            assert g["total_active"] == 400
            assert g["percentage"] == round(want / 400 * 100, 1)
    # counts never shrink as the target date grows
    for i in range(7):
        seq = [got[(t, i)]["projects_reached"] for t in sorted(targets)]
        assert seq == sorted(seq)


def test_folds_are_equal(spark):
    rows = [(g, i // 3) for g, n in ((0, 537), (1, 41)) for i in range(n)]  # projects repeat
    df = spark.createDataFrame(rows, "gap int, project_id long").repartition(3)
    k = F.when(F.col("gap") == 0, 5).otherwise(4)
    got = {(r.gap, r.fold): r["count"] for r in with_folds(df, k, ["gap"]).groupBy("gap", "fold").count().collect()}
    assert n_folds(537) == 5 and n_folds(41) == 4
    assert sorted(got[0, f] for f in range(5)) == [107, 107, 107, 108, 108]
    assert sorted(got[1, f] for f in range(4)) == [10, 10, 10, 11]


def test_rank_is_exact(spark):
    from milepost.functions.ranking import with_rank
    rng = random.Random(8)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 1, 2, 3, 4, 5])) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    got = with_rank(df, ["v"], ["g"], size="n").collect()
    for g in (None, "a", "b"):
        mine = sorted((r["rank"], r.v is not None, r.v or 0, r.n) for r in got if r.g == g)
        assert [m[0] for m in mine] == list(range(len(mine))) and {m[3] for m in mine} == {len(mine)}
        assert [m[1:3] for m in mine] == sorted(m[1:3] for m in mine)
    every = with_rank(df, ["g", "v"]).collect()
    assert sorted(r["rank"] for r in every) == list(range(500))
    assert with_rank(df.limit(0), ["v"], ["g"]).count() == 0


def test_too_few_rows_keep_mean(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(10)], f"project_id long, {GAPS[0]} double")
    stats = {"n": 10, "mean": 4.5, "min": 0.0, "max": 9.0}
    pred, rep = train_gap(rows, 0, stats)
    assert rep == {"gap": GAPS[0], "model": "mean_fallback", "n": 10}
    assert pred.model is None and pred.mean_or_default == 4.5


@pytest.mark.parametrize("n,k", [(20, 2), (49, 4), (50, 5), (5000, 5)])
def test_fold_count(n, k):
    assert n_folds(n) == k


def test_small_training_selects_a_model(spark):
    # y depends on one feature; every candidate beats the mean, so a model is chosen
    rng = np.random.default_rng(1)
    from milepost.constants import BASE_FEATURES
    n = 120
    data = []
    for i in range(n):
        x = float(rng.normal())
        feats = [x] + [float(rng.normal()) for _ in BASE_FEATURES[1:]]
        data.append((i, *feats, 30 + 10 * x + float(rng.normal())))
    cols = ["project_id"] + BASE_FEATURES + [GAPS[0]]
    df = spark.createDataFrame(data, ", ".join(f"{c} {'long' if c == 'project_id' else 'double'}"
                                               for c in cols))
    stats = df.agg(F.count(GAPS[0]).alias("n"), F.avg(GAPS[0]).alias("mean"),
                   F.min(GAPS[0]).alias("min"), F.max(GAPS[0]).alias("max")).first()
    pred, rep = train_gap(df, 0, stats)
    assert rep["model"] in ("GradientBoosting", "RandomForest", "Ridge")
    assert rep["cv_r2"] > 0.5 and rep["n"] == n
    out = pred.predict(df, {}, "p").select("p").collect()
    assert all(stats["min"] <= r["p"] <= stats["max"] for r in out)


def test_medians_equal_exact(spark):
    from milepost.functions.quantiles import exact_medians, grouped_medians
    rng = random.Random(5)
    rows = [(rng.gauss(0, 1), float(rng.randint(0, 3)), None if i % 7 == 0 else rng.random() * 1000,
             5.0 if i % 3 else rng.random()) for i in range(20001)]
    df = spark.createDataFrame(rows, "a double, b double, c double, t double").repartition(4)
    got = exact_medians(df, ["a", "b", "c", "t"])
    want = df.agg(*[F.median(c).alias(c) for c in "abct"]).first().asDict()
    for c in "abct":
        assert got[c] == pytest.approx(want[c], rel=1e-12, abs=1e-12)
    assert exact_medians(df.where("a > 100"), ["a"]) == {"a": None}
    groups = {"low": (F.col("b") < 2, ["a", "c"]), "all": (F.lit(True), ["t"]), "none": (F.lit(False), ["a"])}
    rows = {(r["group"], r["column"]): r["median"] for r in grouped_medians(df, groups).collect()}
    low = df.where("b < 2").agg(F.median("a").alias("a"), F.median("c").alias("c")).first()
    assert set(rows) == {("low", "a"), ("low", "c"), ("all", "t")}
    assert rows["low", "a"] == pytest.approx(low["a"]) and rows["low", "c"] == pytest.approx(low["c"])


def test_feature_without_values_is_left_out(spark):
    from milepost.constants import BASE_FEATURES
    rng = np.random.default_rng(2)
    data = [(i, None, *(float(v) for v in rng.normal(size=len(BASE_FEATURES) - 1)), float(rng.normal()))
            for i in range(60)]
    df = spark.createDataFrame(data, ", ".join(["project_id long"] + [f"{c} double" for c in BASE_FEATURES]
                                               + [f"{GAPS[0]} double"]))
    pred, rep = train_gap(df, 0, {"n": 60, "mean": 0.0, "min": -5.0, "max": 5.0}, candidates=["Ridge"])
    assert rep["model"] == "Ridge" and BASE_FEATURES[0] not in pred.features
    assert len(pred.features) == len(BASE_FEATURES) - 1
    assert pred.predict(df, {}, "p").where("p is null").count() == 0


def test_folds_take_the_seed(spark):
    df = spark.range(0, 400).withColumnRenamed("id", "project_id")
    a = {r["project_id"]: r["fold"] for r in with_folds(df, 5, seed=1).collect()}
    b = {r["project_id"]: r["fold"] for r in with_folds(df, 5, seed=2).collect()}
    assert a != b and set(a.values()) == set(b.values()) == set(range(5))


def test_snapshot_from_stored_counts_equals_direct(spark, tmp_path):
    from milepost.operators.snapshot import snapshot_from_counts, stage_day_counts
    base = dt.date(2021, 1, 1)
    rows = [(i, base + dt.timedelta(days=i % 50), None if i % 3 else base + dt.timedelta(days=i),
             None, None, None, None, None) for i in range(300)]
    fc = spark.createDataFrame(rows, "project_id long, " + ", ".join(f"{c} date" for c in STAGE_COLS))
    stage_day_counts(fc).write.parquet(str(tmp_path / "counts"))
    t = spark.createDataFrame([(base + dt.timedelta(days=d),) for d in (10, 40, 400)], "target_date date")
    direct = snapshot(fc, t)
    stored = snapshot_from_counts(spark.read.parquet(str(tmp_path / "counts")), t)
    assert direct.exceptAll(stored).count() == 0 and stored.exceptAll(direct).count() == 0


def test_training_is_deterministic(spark):
    from milepost.constants import BASE_FEATURES
    rng = np.random.default_rng(4)
    data = []
    for i in range(100):
        x = [float(v) for v in rng.normal(size=len(BASE_FEATURES))]
        data.append((i, *x, 40 + 5 * x[0] + float(rng.normal())))
    cols = ["project_id"] + BASE_FEATURES + [GAPS[0]]
    df = spark.createDataFrame(data, ", ".join(f"{c} {'long' if c == 'project_id' else 'double'}"
                                               for c in cols)).repartition(3, "project_id")
    stats = {"n": 100, "mean": 40.0, "min": 0.0, "max": 100.0}
    p1, r1 = train_gap(df, 0, stats)
    p2, r2 = train_gap(df, 0, stats)
    assert r1 == r2
    a = [r["p"] for r in p1.predict(df, {}, "p").orderBy("project_id").collect()]
    b = [r["p"] for r in p2.predict(df, {}, "p").orderBy("project_id").collect()]
    assert a == b


def test_learned_forecast_never_goes_back(spark):
    from conftest import SF_SMALL
    from milepost.constants import STAGES
    from milepost.plans import queries as Q
    c = Q.Ctx(spark, SF_SMALL)
    models, report = Q.learned_models(c)
    assert all(p.lo >= 0 for p in models.predictors)          # every gap minimum is >= 0 here
    fc = Q.q_forecast_learned(spark, SF_SMALL).collect()
    assert fc
    for r in fc:
        prev = r["current_date"]
        for k in range(1, 7):
            if r[f"predicted_{STAGES[k]}"]:
                d = r[STAGE_COLS[k]]
                assert d >= prev
                prev = d


def _large_ensemble(trees=150, seed=2):
    from milepost.operators.trees import Ensemble
    rng = np.random.default_rng(seed)
    nodes = []
    for t in range(trees):
        nodes += [(t, i, int(rng.integers(0, 4)), float(rng.normal()), 2 * i + 1, 2 * i + 2, 0.0) for i in range(7)]
        nodes += [(t, i, 0, 0.0, i, i, float(rng.normal())) for i in range(7, 15)]
    return Ensemble(nodes, 3.0, 0.05)


def test_a_large_ensemble_gives_the_same_numbers_compiled(spark):
    e = _large_ensemble()
    rng = np.random.default_rng(5)
    x = [[float(v) for v in rng.normal(size=4)] for _ in range(200)]
    x += [[n[3]] * 4 for n in e.nodes[:7]] + [[float("nan"), float("inf"), float("-inf"), -0.0]]
    df = spark.createDataFrame([(v,) for v in x], "x array<double>")
    got = e.predicted(df, F.col("x"), "p").withColumn("q", e.column(F.col("x"))).collect()
    assert len(got) == len(x) and got[0].__fields__ == ["x", "p", "q"]
    assert all(r.p == r.q for r in got)          # to the last bit
    assert all(r.p == pytest.approx(e.predict_one(list(r.x))) for r in got[:20])


def test_large_ensembles_are_walked_in_many_tasks(spark):
    """Rows of one small file are dealt out, and only stages still to come are predicted."""
    from milepost.operators.forecast import chain
    from milepost.operators.models import GapPredictor, ModelSet
    from milepost.operators.trees import Ensemble
    e = _large_ensemble()
    models = ModelSet([GapPredictor(gap=g, mean=30.0, min=0.0, max=90.0, features=["a", "b", "c", "d"],
                                    medians=dict.fromkeys("abcd", 0.5), model=e) for g in GAPS])
    df = spark.range(50).coalesce(1).selectExpr(
        "id", "cast(id % 8 as int) idx", "date'2024-01-01' start", "cast(id as double) a", "if(id % 3 = 0, null, 0.1) b",
        "cast(id % 7 as double) c", "-0.2D d")
    assert models.spread(df).rdd.getNumPartitions() >= 4
    small = ModelSet([GapPredictor(gap=g, model=Ensemble([(0, 0, 0, 0.0, 0, 0, 1.0)])) for g in GAPS])
    assert small.spread(df).rdd.getNumPartitions() == 1
    plan = chain(models.spread(df), models, "idx", "start")
    assert "aggregate(" not in plan._jdf.queryExecution().optimizedPlan().toString()
    for r in plan.collect():
        x = [r.a, 0.5 if r.b is None else r.b, r.c, r.d]
        days = float(np.round(min(90.0, max(0.0, e.predict_one(x)))))
        assert [r[f"days_{k}"] for k in range(6)] == [days if r.idx <= k else None for k in range(6)]


def test_forests_keep_node_ids_and_grow_the_same_trees(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector
    from milepost.operators import training as T
    data = _samples(spark, 400, 1).select(array_to_vector("x").alias("v"), "y").coalesce(2).cache()
    params = dict(numTrees=8, maxDepth=4, minInstancesPerNode=5, featureSubsetStrategy="sqrt", seed=42)
    kept = T._forest(params, data, 400)
    monkeypatch.setattr(T, "NODE_IDS", 8 * 400 - 1)
    walked = T._forest(params, data, 400)
    assert kept.getCacheNodeIds() and not walked.getCacheNodeIds()
    assert kept.toDebugString.split("\n", 1)[1] == walked.toDebugString.split("\n", 1)[1]
