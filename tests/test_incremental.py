"""Refreshes: bucketed master, signed counts, mergeable statistics, versioned model sets."""

import datetime as dt
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from milepost.constants import GAPS, STAGE_COLS, STAGES
from milepost.operators import incremental as I
from milepost.operators.master import master_dataset
from milepost.operators.models import GapPredictor, ModelSet
from milepost.operators.trees import Ensemble
from milepost.plans import queries as Q
from milepost.sources.fixtures import Fixtures
from milepost.sources.tables import latest_run


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_refresh_touches_only_its_buckets(spark, tmp_path):
    src = {n: d.cache() for n, d in Fixtures(spark, SF_SMALL).sources().items()}
    root = str(tmp_path / "master")
    one = src["project_basic"].where("pink_book_ref % 17 <> 0").first()["project_id"]
    before = dict(src)
    before["three_A_master"] = src["three_A_master"].where(F.col("project_id") != one)
    first = I.write_master(master_dataset(before), root, buckets=16)
    changes = {"three_A_master": src["three_A_master"].where(F.col("project_id") == one)}
    ids = I.refresh_master(src, changes, root)
    assert [r[0] for r in ids.collect()] == [one]
    now = I.read_master(spark, root)
    assert same(now, master_dataset(src))
    bucket = spark.range(1).select(F.lit(one).alias("project_id")).select(I._bucket(16)).first()[0]
    runs = {f.split(f"{I._BUCKET}=")[1].split("/")[0]: f.split("run=")[1].split("/")[0] for f in now.inputFiles()}
    assert {b for b, r in runs.items() if r != first} == {str(bucket)}    # the others were not written
    only = I.read_master(spark, root, [bucket])
    assert all(f"{I._BUCKET}={bucket}/" in f for f in only.inputFiles())  # and not read
    plan = I.narrowed(src, ids)["court_case"]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_refresh_with_a_vanished_project_and_no_change(spark, tmp_path):
    src = Fixtures(spark, SF_SMALL).sources()
    root = str(tmp_path / "master")
    I.write_master(master_dataset(src), root, buckets=4)
    run = latest_run(spark, root)
    assert I.refresh_master(src, {}, root).count() == 0 and latest_run(spark, root) == run
    gone = src["project_basic"].where("project_id < 40")
    now = dict(src, project_basic=src["project_basic"].where("project_id >= 40"))
    I.refresh_master(now, {"project_basic": gone}, root)
    assert same(I.read_master(spark, root), master_dataset(now))


@pytest.fixture
def few_partitions(spark):
    """Shuffles of a few partitions from the start: this file's tables are small."""
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "4")
    yield
    spark.conf.unset(key) if was is None else spark.conf.set(key, was)


@pytest.mark.parametrize("most_bits", [1 << 27, 64])
def test_key_bits_rule_out_no_key(spark, monkeypatch, most_bits):
    monkeypatch.setattr(I, "MOST_BITS", most_bits)
    keys = spark.range(0, 40_000, 7).select(F.col("id").cast("int").alias("k"))
    bits = I.KeyBits(keys)
    rows = spark.range(-500, 50_000).select(F.when(F.col("id") != -1, F.col("id")).alias("k")) \
        .unionByName(spark.range(1).select(F.lit(1 << 40).alias("k")))
    got = {r.k: r["__may"] for r in bits.marked(rows).collect()}
    assert len(got) == 50_501 and all(got[k] for k in range(0, 40_000, 7))
    # the bitmap is full where it has too few bits, otherwise few others share a hash
    assert most_bits == 64 or sum(got.values()) < 1.2 * len(range(0, 40_000, 7))
    assert same(bits.possible(rows).join(keys, "k", "left_semi"), keys.withColumn("k", F.col("k").cast("bigint")))
    assert not any(r["__may"] for r in I.KeyBits(keys.limit(0)).marked(rows).collect())


@pytest.mark.parametrize("files", [32, 0])
def test_a_refresh_deals_only_rows_of_affected_projects(spark, few_partitions, tmp_path, monkeypatch, files):
    monkeypatch.setattr(I, "FILES_PER_BUCKET", files)
    src = {n: d.cache() for n, d in Fixtures(spark, SF_SMALL).sources().items()}
    root = str(tmp_path / "master")
    late = F.pmod("project_id", F.lit(50)) == 7
    before = dict(src, three_A_master=src["three_A_master"].where(~late))
    I.write_master(master_dataset(before), root, buckets=4)
    dealt, write = [], I._write_buckets

    def seen(rows, *args):
        dealt.append(rows.count())
        return write(rows, *args)
    monkeypatch.setattr(I, "_write_buckets", seen)
    ids = I.refresh_master(src, {"three_A_master": src["three_A_master"].where(late)}, root)
    now = I.read_master(spark, root)
    affected, every = now.join(ids, "project_id", "left_semi").count(), now.count()
    assert same(now, master_dataset(src)) and 0 < affected < every / 10
    assert dealt[0] == every if files == 0 else affected <= dealt[0] < 1.2 * affected + 10
    shuffled = I.narrowed(src, ids)["three_A_objections"]._jdf.queryExecution().optimizedPlan().toString()
    assert shuffled.index("LeftSemi") < shuffled.index("__bits")          # the bitmap comes before the join


def test_signed_counts_equal_a_recount(spark):
    from milepost.operators.snapshot import stage_day_counts
    rng = random.Random(2)
    base = dt.date(2020, 1, 1)

    def table(rows):
        return spark.createDataFrame([(i, *r) for i, r in rows.items()],
                                     "project_id long, " + ", ".join(f"{c} date" for c in STAGE_COLS))

    def row():
        return tuple(None if rng.random() < 0.3 else base + dt.timedelta(days=rng.randint(0, 60)) for _ in STAGE_COLS)
    now = {i: row() for i in range(200)}
    counts = stage_day_counts(table(now))
    for _ in range(2):
        changed = rng.sample(range(260), 60)
        old = {i: now[i] for i in changed if i in now}
        new = {i: row() for i in changed if rng.random() < 0.8}
        now = {i: r for i, r in now.items() if i not in changed} | new
        counts = I.merged_counts(counts, I.count_deltas(table(old), table(new)))
        assert same(counts, stage_day_counts(table(now)))
        counts = spark.createDataFrame(counts.collect(), counts.schema)


def test_states_combine_without_cancellation(spark):
    rng = np.random.default_rng(3)
    rows = [(int(p), float(v), *[None] * 5) for p, v in zip(rng.integers(0, 9, 500), 1e9 + rng.normal(size=500))]
    rows += [(50, -1.0 * 1e9, *[None] * 5), (51, None, *[None] * 5)]
    df = spark.createDataFrame(rows, "part int, " + ", ".join(f"{g} double" for g in GAPS))
    for part in ("part >= 0", "part < 9"):
        mine = df.where(part)
        got = {(r.kind, r.idx): r for r in I.combined_states(I.statistic_states(mine, ["part"])).collect()}
        v = np.array([r[0] for r in mine.where(f"{GAPS[0]} is not null").select(GAPS[0]).collect()])
        r = got["gap", 0]
        assert (r.n, r["min"], r["max"]) == (len(v), v.min(), v.max())
        # a double near 1e9 is exact to 1e-7, so a spread of 1 can't be better known than this
        assert r["mean"] == pytest.approx(v.mean(), rel=1e-12) and r["std"] == pytest.approx(v.std(ddof=1), rel=1e-8)
        logs = np.log(v[v > -1] + 1)
        assert got["stage", 1].lognorm_mu == pytest.approx(logs.mean(), rel=1e-12)
        assert got["stage", 1].lognorm_sigma == pytest.approx(logs.std(ddof=1), rel=1e-6)
        assert ("gap", 1) not in got
    one = I.combined_states(I.statistic_states(df.where("part = 50"), ["part"])).where("kind = 'gap'").first()
    assert one.n == 1 and one["std"] is None and one["mean"] == -1e9


def _set(days: float) -> ModelSet:
    leaf = Ensemble([(0, 0, 0, 0.0, 0, 0, days)])
    return ModelSet([GapPredictor(g, "GradientBoosting", 50.0, 0.0, 999.0, 5, ["government_land"],
                                  {"government_land": 1.0}, leaf) for g in GAPS])


def test_stream_follows_published_models(spark, tmp_path):
    from milepost.streaming.requests import start_versioned_scoring
    c = Q.Ctx(spark, SF_SMALL)
    rc, dc = c.codes
    models, source, sink = (str(tmp_path / n) for n in ("models", "in", "out"))
    os.makedirs(source)

    def publish(days, version):
        ms = _set(days)
        ms.railway_codes, ms.division_codes, ms.scores = rc, dc, c.scores
        ms.save(models, version)

    def arrive(i):
        body = json.dumps({"current_stage": "20H", "current_date": "1-1-2020"})
        with open(f"{source}/{i}.json", "w") as f:
            f.write(json.dumps({"request_id": i, "body": body}) + "\n")
        start_versioned_scoring(spark, source, sink, str(tmp_path / "ckpt"), models, "2025-01-01",
                                available_now=True).awaitTermination(300)
    publish(10.0, "a")
    arrive(1)
    publish(70.0, "b")
    arrive(2)
    got = {r.request_id: r for r in spark.read.parquet(f"{sink}/batch=*").collect()}
    days = {i: [p["predicted_days"] for p in json.loads(r.response)["predictions"]] for i, r in got.items()}
    assert days == {1: [10], 2: [70]} and {i: r.model_version for i, r in got.items()} == {1: "a", 2: "b"}
    assert ModelSet.load(spark, models).version == "b" and ModelSet.load(spark, models, "a").version == "a"


def test_unpublished_sets_are_not_seen(spark, tmp_path):
    path = str(tmp_path / "models")
    with pytest.raises(FileNotFoundError):
        ModelSet.load(spark, path)
    _set(1.0).save(path, "whole")

    def fails(folder):
        raise RuntimeError("stopped before publishing")
    with pytest.raises(RuntimeError):
        _set(2.0).save(path, "half", extra=fails)
    assert ModelSet.load(spark, path).version == "whole"
    assert ModelSet.load(spark, path)[0].model.predict_one([0.0]) == 1.0


def test_maintained_forecast_is_published_whole(spark, tmp_path):
    from milepost.plans.jobs import publish_forecast, stored_counts, stored_forecast
    base = dt.date(2021, 1, 1)
    fc = spark.createDataFrame([(i, *[base + dt.timedelta(days=i)] * 7) for i in range(5)],
                               "project_id long, " + ", ".join(f"{c} date" for c in STAGE_COLS))
    path = str(tmp_path / "fc")
    publish_forecast(fc, path)
    publish_forecast(fc.limit(2), path)
    assert stored_forecast(spark, path).count() == 2
    assert stored_counts(spark, path).agg(F.sum("cnt")).first()[0] == 2 * len(STAGES)
