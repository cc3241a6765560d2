"""End-to-end jobs: snapshot store, artifacts, report, stream scoring."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from milepost.operators.digitalization import (PERCENT_FIELD, digitalization_scores,
                                               read_records)
from milepost.operators.models import ModelSet
from milepost.operators.scoring import decode_requests, envelope, score_requests
from milepost.plans import jobs
from milepost.plans.queries import Ctx
from milepost.sources.fixtures import Fixtures
from milepost.sources.tables import (latest_run, list_runs, read_jdbc_tables, read_snapshot,
                                     write_snapshot)
from milepost.streaming.requests import start_request_scoring


def test_snapshot_store_round_trip(spark):
    root = tempfile.mkdtemp(prefix="snap-")
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    write_snapshot(df, root, run="20250101_000000")
    write_snapshot(df.limit(3), root, run="20250102_000000")
    assert [os.path.basename(p) for p in list_runs(spark, root)] == [
        "run=20250102_000000", "run=20250101_000000"]
    assert read_snapshot(spark, root).count() == 3          # the published run
    write_snapshot(df.limit(1), root, run="20241231_000000")
    assert read_snapshot(spark, root).count() == 1          # the last one published, not the newest name
    assert latest_run(spark, root).endswith("run=20241231_000000")
    runs = spark.read.option("basePath", root).parquet(f"{root}/run=*")
    assert runs.count() == 9                                # every run is stored once


def test_jdbc_demands_partitioning(spark):
    with pytest.raises(ValueError, match="three_A_master"):
        read_jdbc_tables(spark, "jdbc:none", {}, {"project_basic": ("project_id", 0, 9, 3)},
                         ["project_basic", "three_A_master"])


def test_records_reader(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="rec-"), "payload.json")
    records = [{"state_ut": " Punjab ", PERCENT_FIELD: "99.0"}, {"state_ut": "Goa", PERCENT_FIELD: 12.5},
               {"state_ut": "Punjab", PERCENT_FIELD: "50.0"}, {"state_ut": "Nowhere", PERCENT_FIELD: "x"},
               {"state_ut": "Kerala", PERCENT_FIELD: None}]
    from milepost.operators.digitalization import default_state_dim

    def scores(rows):
        with open(path, "w") as f:
            json.dump({"total": len(rows), "records": rows}, f, indent=1)
        return {r["state_code"]: r["score"] for r in digitalization_scores(
            default_state_dim(spark), read_records(spark, path)).collect()}

    got = scores(records)  # the last record of a state in the array counts
    assert got[3] == 0.5 and got[30] == 0.125 and got[1] == 0.7054 and got[12] == 0.0
    bad = scores([*records, {"state_ut": "Goa", PERCENT_FIELD: "n/a"}])
    assert bad[3] == 0.9962 and bad[30] == 1.0  # a malformed percentage drops all live scores


def test_train_forecast_snapshot_jobs(spark):
    work = tempfile.mkdtemp(prefix="jobs-")
    fx = Fixtures(spark, SF_SMALL)
    report = jobs.train_job(spark, fx.sources(), f"{work}/master", f"{work}/models",
                            state_dim=fx["state_dim"], records=fx["digitalization_records"])
    rep = {r["gap"]: r for r in report.collect()}
    assert len(rep) == 6 and all(r["n"] > 0 for r in rep.values())
    doc = json.loads(spark.read.text(f"{latest_run(spark, f'{work}/models')}/report").first()[0])
    assert len(doc["trained_on"]) == len("31-12-2025 00:00:00")
    assert doc["dataset_rows"] == read_snapshot(spark, f"{work}/master").count()
    assert set(doc["stage_durations"]) == {"7A", "20A", "20E", "20F", "20H", "Mutation"}
    targets = fx["target_dates"]
    snap = jobs.forecast_job(spark, f"{work}/master", f"{work}/models", f"{work}/forecast", targets)
    rows = snap.collect()
    assert len(rows) == 7 * targets.count()
    assert all(0 <= r["projects_reached"] <= r["total_active"] for r in rows)
    out = jobs.stage_snapshot(spark, f"{work}/forecast", f"{work}/models",
                              ["31-12-1996", "31-02-1996"]).collect()
    assert sum(1 for r in out if r["error"] is not None) == 1
    assert sum(1 for r in out if r["stage"] is not None) == 7
    # models reload with their pipelines and give the same forecast
    ms = ModelSet.load(spark, f"{work}/models")
    assert {p.gap: p.kind for p in ms.predictors} == {g: r["model"] for g, r in rep.items()}
    learned = [p for p in ms.predictors if p.model is not None]
    assert all(p.features and p.medians for p in learned)
    assert {"mean", "std", "min", "max", "n"} <= set(ms.gap_stats.columns)
    assert ms.gap_stats.count() == 6
    # the reloaded pipelines score a request stream exactly as a batch
    src = tempfile.mkdtemp(prefix="req-src-")
    with open(os.path.join(src, "a.json"), "w") as f:
        for i, stage in enumerate(["37A", "7A", "20A", "20E", "XX"]):
            body = {"railway": "CR", "current_stage": stage, "current_date": f"{i + 1}-3-1996",
                    "states": "5, 7", "government_land": 10 * i}
            f.write(json.dumps({"request_id": i, "body": json.dumps(body)}) + "\n")
    sink, ckpt = tempfile.mkdtemp(prefix="req-out-"), tempfile.mkdtemp(prefix="req-ck-")
    q = start_request_scoring(spark, src, sink, ckpt, ms, as_of="2025-01-01", available_now=True)
    q.awaitTermination(300)
    got = spark.read.parquet(sink)
    batch = envelope(score_requests(decode_requests(
        spark.read.schema("request_id long, body string").json(src), body_col="body",
        as_of="2025-01-01"), ms))
    assert got.count() == 5 and got.exceptAll(batch.select(*got.columns)).count() == 0


def test_stream_scoring_equals_batch(spark):
    c = Ctx(spark, SF_SMALL)
    mm = c.mean_models()
    src = tempfile.mkdtemp(prefix="req-src-")
    reqs = c.fx["requests"].limit(40).collect()
    with open(os.path.join(src, "a.json"), "w") as f:
        for r in reqs:
            body = {k: r[k] for k in r.asDict() if k not in ("request_id", "current_date_text")
                    and r[k] is not None}
            body["current_date"] = r["current_date_text"]
            f.write(json.dumps({"request_id": r["request_id"], "body": json.dumps(body)}) + "\n")
    sink, ckpt = tempfile.mkdtemp(prefix="req-out-"), tempfile.mkdtemp(prefix="req-ck-")
    q = start_request_scoring(spark, src, sink, ckpt, mm, as_of="2025-01-01", available_now=True)
    q.awaitTermination(300)
    got = spark.read.parquet(sink)
    batch = envelope(score_requests(decode_requests(
        spark.read.schema("request_id long, body string").json(src), body_col="body",
        as_of="2025-01-01"), mm))
    assert got.count() == 40
    assert got.exceptAll(batch.select(*got.columns)).count() == 0


def test_objection_models_score_requests(spark):
    c = Ctx(spark, SF_SMALL)
    models, report = jobs.fit_models(c.master, c.scores, with_objections=True)
    learned = [p for p in models.predictors if p.model is not None]
    assert learned and all("objection_count" in p.features for p in learned)
    scored = score_requests(c.requests(), models)
    env = envelope(scored).where("success").select("n_predictions").collect()
    assert len(env) == c.fx["requests"].count()


def test_service_calls(spark):
    from milepost.operators.forecast import forecast
    from milepost.plans import service
    c = Ctx(spark, SF_SMALL)
    mm = c.mean_models()
    fc = forecast(c.master, mm)
    h = service.health(fc).first()
    assert h["status"] == "ok" and h["active_projects"] == fc.count()
    req = spark.createDataFrame(
        [(1, json.dumps({"current_stage": "20A", "current_date": "12-11-2025"})),
         (2, json.dumps({"government_land": "lots"}))], "request_id long, body string")
    out = {r["request_id"]: json.loads(r["response"]) for r in service.predict_stages(req, mm).collect()}
    assert out[1]["success"] and [p["stage"] for p in out[1]["predictions"]] == [
        "20E", "20F", "20H", "Mutation"]
    running = [p["gap_from_now"] for p in out[1]["predictions"]]
    assert running == sorted(running) and out[1]["current_date"] == "12-11-2025"
    assert out[2]["success"] is False and "government_land" in out[2]["error"]
    texts = spark.createDataFrame([("31-12-1996",), ("31-02-1996",)], "target_date string")
    snap = {r["target_input"]: json.loads(r["response"])
            for r in service.pipeline_snapshot(fc, texts, mm).collect()}
    assert snap["31-02-1996"] == {"success": False, "error": service.BAD_DATE}
    good = snap["31-12-1996"]
    assert good["total_active"] == h["active_projects"] and len(good["stage_snapshot"]) == 7


def test_command_line(spark, capsys):
    from milepost.__main__ import main
    from milepost.sources.fixtures import SOURCE_TABLES
    work = tempfile.mkdtemp(prefix="cli-")
    fx = Fixtures(spark, SF_SMALL)
    for n in SOURCE_TABLES:
        fx[n].write.parquet(f"{work}/sources/{n}")
    with open(f"{work}/records.json", "w") as f:
        json.dump({"records": [{"state_ut": "Goa", PERCENT_FIELD: "12.5"}]}, f)
    assert main(["train", "--sources", f"{work}/sources", "--master", f"{work}/master",
                 "--models", f"{work}/models", "--records", f"{work}/records.json"]) == 0
    assert main(["forecast", "--master", f"{work}/master", "--models", f"{work}/models",
                 "--out", f"{work}/fc"]) == 0
    capsys.readouterr()
    assert main(["snapshot", "--forecast", f"{work}/fc", "--models", f"{work}/models",
                 "--dates", "31-12-1996", "bad"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]
    assert sorted(x["success"] for x in lines) == [False, True]
    with open(f"{work}/req.json", "w") as f:
        f.write(json.dumps({"request_id": 1, "body": json.dumps({"current_stage": "20F"})}) + "\n")
    assert main(["predict", "--requests", f"{work}/req.json", "--models", f"{work}/models",
                 "--out", f"{work}/pred", "--as-of", "2025-01-01"]) == 0
    resp = json.loads(spark.read.json(f"{work}/pred").first()["response"])
    assert [p["stage"] for p in resp["predictions"]] == ["20H", "Mutation"]
