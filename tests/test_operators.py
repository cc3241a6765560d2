"""Hand-made rows for each quirk of the source system."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from milepost.constants import GAPS, STAGE_COLS
from milepost.functions import columns as C
from milepost.functions.encoding import encode, fit_label_codes
from milepost.operators import master as M
from milepost.operators.digitalization import digitalization_scores
from milepost.operators.features import build_features
from milepost.operators.forecast import forecast
from milepost.operators.models import GapPredictor, ModelSet
from milepost.operators.scoring import decode_requests

D = dt.date


def test_court_case_multiplicity_and_nulls(spark):
    cases = spark.createDataFrame(
        [(1, 10, "Active", D(2020, 1, 1), None), (2, 10, None, D(2019, 1, 1), D(2021, 1, 1)),
         (3, 11, "Closed", D(2020, 5, 1), D(2020, 6, 1)), (4, 12, "ACTIVE ", None, None)],
        "case_id long, project_id long, status string, from_date date, to_date date")
    det = spark.createDataFrame(
        [(1, 100, 2.0), (1, 101, None), (1, 100, 1.0), (3, 200, 5.0), (9, 900, 7.0)],
        "case_id long, survey_id long, area double")
    got = {r["project_id"]: r for r in M.court_case_summary(cases, det).collect()}
    # case 1 has three detail rows, so its Active status counts three times
    assert got[10]["active_court_cases"] == 3
    assert got[10]["court_case_count"] == 2
    assert got[10]["total_disputed_area"] == 3.0
    assert got[10]["disputed_surveys"] == 2
    assert got[10]["first_court_case_date"] == D(2019, 1, 1)
    assert got[10]["last_court_case_date"] == D(2021, 1, 1)
    assert got[11]["active_court_cases"] == 0 and got[11]["disputed_surveys"] == 1
    assert got[12]["active_court_cases"] == 0 and got[12]["total_disputed_area"] == 0.0
    per_case = {r["project_id"]: r for r in M.court_case_summary(cases, det, per_case=True).collect()}
    assert per_case[10]["active_court_cases"] == 1
    lcase = {r["project_id"]: r for r in
             M.court_case_summary(cases, det, collation="UTF8_LCASE_RTRIM").collect()}
    assert lcase[12]["active_court_cases"] == 1


def test_dates_and_lists(spark):
    df = spark.createDataFrame([("1-2-2025", "x, 7", None), ("31-02-2025", None, "5,12"),
                                ("n/a", "3", "x,12")], "t string, s string, d string")
    r = df.select(C.parse_date("t").alias("p"), C.format_date(C.parse_date("t")).alias("f"),
                  C.first_digit_token("s", 3).alias("ps"), C.digit_token_count("s").alias("ns"),
                  C.first_token_int("d", 0).alias("pd"), C.token_count("d", 1).alias("nd")).collect()
    assert r[0]["p"] == D(2025, 2, 1) and r[0]["f"] == "01-02-2025"
    assert r[1]["p"] is None and r[2]["p"] is None
    assert (r[0]["ps"], r[0]["ns"]) == (7, 1)
    assert (r[1]["ps"], r[1]["ns"]) == (3, 0)
    assert (r[0]["pd"], r[0]["nd"]) == (0, 1)        # NULL text: 0 / 1
    assert (r[1]["pd"], r[1]["nd"]) == (5, 2)
    assert (r[2]["pd"], r[2]["nd"]) == (0, 2)        # non-numeric first token


def test_label_codes_binary_order_and_unseen(spark):
    df = spark.createDataFrame([("Corporate Office",), ("CSTM",), ("ECoR",), ("ECR",), (None,),
                                ("CSTM",)], "division string")
    codes = {r["label"]: r["code"] for r in fit_label_codes(df, "division", partitions=3).collect()}
    assert codes == {"CSTM": 0, "Corporate Office": 1, "ECR": 2, "ECoR": 3, "nan": 4}
    req = spark.createDataFrame([("ECoR",), ("ZZZ",), (None,)], "division string")
    enc = [r["enc"] for r in encode(req, "division", fit_label_codes(df, "division"), "enc")
           .orderBy(F.col("division").asc_nulls_last()).collect()]
    assert enc == [3, 0, 4]


def test_digitalization_overlay(spark):
    dim = spark.createDataFrame([(1, "A", 0.5), (2, "B", None), (3, "C", 0.9)],
                                "state_code int, state_name string, fallback_score double")
    rec = spark.createDataFrame([(0, " A ", "10.0"), (1, "A", "20.0"), (2, "B", "33.33"),
                                 (3, "Z", "bad"), (4, "C", None)],
                                "ord int, state_ut string, pct_completed string")
    got = {r["state_code"]: r["score"] for r in digitalization_scores(dim, rec).collect()}
    assert got == {1: 0.2, 2: 0.3333, 3: 0.9}       # last record wins, unmapped skipped
    bad = rec.union(spark.createDataFrame([(5, "A", "x")], rec.schema))
    got = {r["state_code"]: r["score"] for r in digitalization_scores(dim, bad).collect()}
    assert got == {1: 0.5, 3: 0.9}                  # one bad number: whole fallback


def _master_rows(spark):
    schema = ("project_id long, railway string, division string, states string, districts string, "
              "government_land double, private_land double, forest_area double, total_land double, "
              "court_case_count long, active_court_cases long, " +
              ", ".join(f"{c} date" for c in STAGE_COLS))
    rows = [
        (1, "NR", "DLI", None, "27", 0.0, 0.0, 0.0, 0.0, None, None,
         D(2020, 1, 1), None, D(2020, 6, 1), None, None, None, None),        # hole at 7A
        (2, "CR", "ADI", "x, 7", "3", 10.0, 20.0, 30.0, 60.0, 2, 1,
         D(2021, 1, 1), D(2021, 2, 1), None, None, None, None, None),
        (3, "CR", "ADI", "5", "3", 1.0, 1.0, 1.0, 3.0, 0, 0,
         D(2021, 1, 1), D(2021, 2, 1), None, None, None, None, D(2022, 1, 1)),  # not active
    ]
    return spark.createDataFrame(rows, schema)


def _mean_models(spark, master, means):
    rc, dc = fit_label_codes(master, "railway"), fit_label_codes(master, "division")
    scores = spark.createDataFrame([(7, 0.25)], "state_code int, score double")
    preds = [GapPredictor(gap=g, mean=m, min=1.0, max=1000.0, n=100) for g, m in zip(GAPS, means)]
    return ModelSet(preds, railway_codes=rc, division_codes=dc, scores=scores)


def test_project_features_and_mean_chain(spark):
    m = _master_rows(spark)
    ms = _mean_models(spark, m, [10.7, 20.2, 30.9, None, 5.5, -3.5])
    f = {r["project_id"]: r for r in build_features(m, "project", ms.railway_codes,
                                                    ms.division_codes, ms.scores).collect()}
    assert f[1]["government_land"] == 30.0 and f[1]["private_land"] == 60.0
    assert f[1]["primary_state"] == 3 and f[1]["num_states"] == 0
    assert f[1]["court_case_count"] == 0
    assert f[2]["primary_state"] == 7 and f[2]["digitalization_score"] == 0.25
    assert f[1]["digitalization_score"] == 0.70
    assert f[2]["land_difficulty_score"] == pytest.approx((30 * 3 + 20 * 2 + 10) / 60)
    fc = {r["project_id"]: r for r in forecast(m, ms).collect()}
    assert set(fc) == {1, 2}
    p1 = fc[1]                                     # current stage 20A (index 2), 7A stays NULL
    assert p1["current_stage"] == "20A" and p1["date_7A"] is None
    # gap 2 mean 30.9 -> 30 days, gap 3 has no statistics -> 90, then 5, then -3
    assert p1["date_20E"] == D(2020, 7, 1)
    assert p1["date_20F"] == D(2020, 9, 29)
    assert p1["date_20H"] == D(2020, 10, 4)
    assert p1["mutation_date"] == D(2020, 10, 1)
    assert fc[2]["date_20A"] == D(2021, 2, 21)


def test_training_rules(spark):
    m = _master_rows(spark)
    ms = _mean_models(spark, m, [1.0] * 6)
    f = {r["project_id"]: r for r in build_features(m, "train", ms.railway_codes,
                                                    ms.division_codes, ms.scores).collect()}
    assert f[1]["primary_state"] == 0 and f[1]["num_states"] == 1
    assert f[2]["primary_state"] == 0 and f[2]["num_states"] == 2     # 'x, 7'
    assert f[1]["land_difficulty_score"] == 0.0                       # 0 / (0 -> 1)
    assert f[1]["gap_37A_7A"] is None and f[3]["gap_37A_7A"] == 31


def test_clamp_round_half_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (0.4,), (500.0,)], "p double")
    got = [r[0] for r in df.select(C.clamp_round("p", F.lit(0.0), F.lit(100.0))).collect()]
    assert got == [2.0, 4.0, 0.0, 100.0]


def test_predictor_defaults():
    p = GapPredictor(gap="gap_7A_20A", mean=None, min=float("nan"), max=None)
    assert (p.mean_or_default, p.lo, p.hi) == (90.0, 20.0, 365.0)


def test_request_decoder(spark):
    df = spark.createDataFrame(
        [(1, '{"railway": "CR", "current_stage": "20A", "current_date": "5-3-2024"}'),
         (2, '{"government_land": "abc", "current_date": "bad"}'),
         (3, '{"private_land": 0, "court_case_count": 2.9}')], "request_id long, body string")
    r = {x["request_id"]: x for x in decode_requests(df, body_col="body",
                                                      as_of="2025-01-01").collect()}
    assert r[1]["railway"] == "CR" and r[1]["current_idx"] == 2
    assert r[1]["start_date"] == D(2024, 3, 5) and r[1]["government_land"] == 30.0
    assert r[2]["error"] is not None and r[2]["start_date"] == D(2025, 1, 1)
    assert r[3]["private_land"] == 0.0 and r[3]["court_case_count"] == 2
    assert r[3]["division"] == "DLI" and r[3]["states"] == "3" and r[3]["current_idx"] == 0


def test_dedupe_keeps_one_allocation(spark):
    pb = spark.createDataFrame([(1, "P1", 10, 1.0, 1.0, 1.0, 3.0, 0.0, 0.0, 1, "O")],
                               "project_id long, project_name string, pink_book_ref long, "
                               "government_land double, private_land double, forest_area double, "
                               "total_land double, land_available double, land_to_be_acquired double, "
                               "state_id int, status string")
    al = spark.createDataFrame([("U10", 10, "W", "NR", "DLI", "A", "7", "27", "Started"),
                                ("U10", 10, "W", "NR", "ADI", "A", "7", "27", "Started"),
                                ("U10", 10, "W", "NR", "ADI", "A", "7", "27", "Started")],
                               "uwid string, PROJECTID long, ShortNameofWork string, railway string, "
                               "division string, exec_agency_rly string, states string, "
                               "districts string, land_acq_status string")
    assert M.project_base(pb, al).count() == 2           # DISTINCT, then one row per allocation
    d = M.project_base(pb, al, dedupe=True).collect()
    assert len(d) == 1 and d[0]["division"] == "ADI"


def test_consistent_mode_uses_training_rules(spark):
    m = _master_rows(spark)
    ms = _mean_models(spark, m, [1.0] * 6)
    f = {r["project_id"]: r for r in build_features(m, "project", ms.railway_codes,
                                                    ms.division_codes, ms.scores,
                                                    consistent=True).collect()}
    assert f[1]["government_land"] == 0.0 and f[1]["primary_state"] == 0
    assert f[1]["num_states"] == 1


def test_snapshot_response_json(spark):
    import json
    from milepost.operators.snapshot import snapshot, snapshot_response
    fc = spark.createDataFrame([(1, D(2020, 1, 1), D(2020, 2, 1), None, None, None, None, None)],
                               "project_id long, " + ", ".join(f"{c} date" for c in STAGE_COLS))
    t = spark.createDataFrame([(D(2020, 1, 15),)], "target_date date")
    doc = json.loads(snapshot_response(snapshot(fc, t)).first()["response"])
    assert doc["success"] is True and doc["target_date"] == "15-01-2020" and doc["total_active"] == 1
    assert [s["stage"] for s in doc["stage_snapshot"]] == ["37A", "7A", "20A", "20E", "20F", "20H",
                                                           "Mutation"]
    assert [s["projects_reached"] for s in doc["stage_snapshot"]] == [1, 0, 0, 0, 0, 0, 0]
    assert doc["stage_snapshot"][0]["percentage"] == 100.0


def test_label_codes_of_two_columns_in_one_pass(spark):
    from milepost.functions.encoding import fit_label_codes_many
    df = spark.createDataFrame([("NR", "DLI"), ("CR", "ADI"), ("NR", None), ("ECoR", "ADI"),
                                ("ECR", "Corporate Office"), ("b", "CSTM")], "railway string, division string")
    got = fit_label_codes_many(df, ["railway", "division"], partitions=4)
    r = {x["label"]: x["code"] for x in got["railway"].collect()}
    d = {x["label"]: x["code"] for x in got["division"].collect()}
    assert r == {"CR": 0, "ECR": 1, "ECoR": 2, "NR": 3, "b": 4}
    assert d == {"ADI": 0, "CSTM": 1, "Corporate Office": 2, "DLI": 3, "nan": 4}


def test_consistent_rules_on_requests(spark):
    from milepost.operators.features import own_features
    from milepost.operators.scoring import decode_requests
    req = spark.createDataFrame([(1, '{"states": "x,7", "government_land": 0, "private_land": 0, "forest_area": 0}'),
                                 (2, '{"government_land": 10, "private_land": 20, "forest_area": 10}')],
                                "request_id long, body string")
    got = {r["request_id"]: r for r in own_features(
        decode_requests(req, body_col="body", as_of="2025-01-01"), "request", consistent=True).collect()}
    assert got[1]["land_difficulty_score"] == 0.0 and got[1]["num_states"] == 2
    assert got[2]["land_difficulty_score"] == (30 + 40 + 10) / 40


def test_request_faults_name_the_field_and_never_fail(spark):
    from milepost.operators.scoring import decode_requests
    bodies = {"not json": "request body is not a JSON object", "[1,2]": "request body is not a JSON object",
              None: "request body is not a JSON object", "{}": None, '{"railway": null}': None,
              '{"government_land": null}': "bad number in government_land",
              '{"court_case_count": 1e30}': "bad number in court_case_count",
              '{"court_case_count": "NaN"}': "bad number in court_case_count",
              '{"court_case_count": "2.9"}': "bad number in court_case_count",
              '{"court_case_count": 2.9}': None, '{"forest_area": "NaN"}': None}
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id long, body string")
    rows = decode_requests(df, body_col="body", as_of="2025-01-01").orderBy("request_id").collect()
    assert [r["error"] for r in rows] == list(bodies.values())
    assert rows[4]["railway"] == "None" and rows[3]["railway"] == "NR"
    assert rows[9]["court_case_count"] == 2 and rows[6]["court_case_count"] == 0


def test_tables_are_dropped(spark):
    from milepost.session import cut_lineage, drop_tables
    from milepost.sources.tables import path_exists
    df = cut_lineage(spark.range(3))
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert path_exists(spark, path) and drop_tables(spark) >= 1 and not path_exists(spark, path)


def test_first_dates_are_grouped_by_project_alone(spark):
    """A feed is one stage, so no task holds a map of (project, stage) texts of all feeds."""
    feed = spark.createDataFrame([(1, "2020-01-02"), (1, "2020-01-01"), (2, None), (None, "2020-05-05")],
                                 "project_id long, t string").selectExpr("project_id", "CAST(t AS DATE) publish_date")
    src = {n: feed for n in ("notification_37A", "la_notification_master", "three_A_master", "three_d_master")}
    out = M.first_stage_dates_long(src)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [project_id") == 4
    assert sorted((r.project_id or 0, r.stage, str(r.first_date)) for r in out.collect()) == sorted(
        (p, s, d) for s in ("37A", "7A", "20A", "20E") for p, d in ((0, "2020-05-05"), (1, "2020-01-01")))


def test_stored_master_has_the_columns_that_a_query_reads(spark):
    """Court cases and objections are left out where only dates are read; every row is there."""
    from milepost.plans import queries as Q
    c = Q.Ctx(spark, "/root/testdata/sf0.001", store=False, columns=Q.DATE_COLS)
    plan = c.master._jdf.queryExecution().optimizedPlan().toString()
    assert "event_id" not in plan and "__hot" not in plan
    whole = Q.Ctx(spark, "/root/testdata/sf0.001", store=False).master.select(*Q.DATE_COLS)
    assert c.master.exceptAll(whole).count() == 0 and whole.exceptAll(c.master).count() == 0
