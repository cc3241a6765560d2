"""A key holding a third of all rows: results stay exact and the plan splits the hot key."""

import random
from collections import defaultdict

import pytest

from milepost.operators import master as M


@pytest.fixture()
def skew_conf(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_case_and_hot_project(spark, skew_conf):
    random.seed(11)
    cases = [(c, 0 if c < 600 else c % 97, "Active" if c % 3 == 0 else None) for c in range(1800)]
    details = []
    for i in range(6000):
        cid = 7 if i % 3 == 0 else random.randrange(1800)   # case 7 holds a third of the rows
        details.append((cid, random.randrange(4000), float(i % 5)))
    cdf = spark.createDataFrame([(c, p, s, None, None) for c, p, s in cases],
                                "case_id long, project_id long, status string, from_date date, to_date date")
    ddf = spark.createDataFrame(details, "case_id long, survey_id long, area double")
    out = M.court_case_summary(cdf, ddf)
    got = {r["project_id"]: r for r in out.collect()}

    # brute force over the joined rows
    by_case = defaultdict(list)
    for c, s, a in details:
        by_case[c].append((s, a))
    want = defaultdict(lambda: {"cases": set(), "active": 0, "area": 0.0, "surveys": set()})
    for c, p, st in cases:
        w = want[p]
        w["cases"].add(c)
        rows = by_case.get(c) or [(None, None)]
        for s, a in rows:
            w["active"] += 1 if st == "Active" else 0
            w["area"] += a or 0.0
            if s is not None:
                w["surveys"].add(s)
    assert set(got) == set(want)
    for p, w in want.items():
        g = got[p]
        assert g["court_case_count"] == len(w["cases"])
        assert g["active_court_cases"] == w["active"]
        assert g["total_disputed_area"] == pytest.approx(w["area"])
        assert g["disputed_surveys"] == len(w["surveys"])

    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "isSkewJoin=true" in plan or "skew=true" in plan


def _hot_tables(spark):
    """Allocations and projects whose keys are hot on one side each, with null keys on both."""
    from pyspark.sql import functions as F
    ab = spark.range(3000).select(
        F.concat(F.lit("U"), "id").alias("uwid"),
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 400)
        .cast("long").alias("PROJECTID"),
        *[F.lit("x").alias(c) for c in M.ALLOCATION_COLS if c not in ("uwid", "PROJECTID")])
    projects = spark.range(900).select(
        F.col("id").alias("project_id"), F.concat(F.lit("P"), "id").alias("project_name"),
        F.when(F.col("id") % 3 == 0, 11).when(F.col("id") % 3 == 1, None).when(F.col("id") % 60 == 2, 7)
        .otherwise(F.col("id")).cast("long").alias("pink_book_ref"),
        *[F.lit(1.0).alias(c) for c in M.PROJECT_COLS[3:-2]],
        F.lit(1).alias("state_id"), F.lit("s").alias("status"))
    return projects, ab.union(ab.limit(500))


@pytest.mark.parametrize("heavy_rows", [100, 10**9])
def test_hot_allocations_and_projects(spark, skew_conf, heavy_rows):
    projects, ab = _hot_tables(spark)
    by_key = defaultdict(set)
    for r in ab.collect():
        by_key[r["PROJECTID"]].add(r["uwid"])
    want = defaultdict(int)
    for r in projects.collect():
        for u in (by_key.get(r["pink_book_ref"]) if r["pink_book_ref"] is not None else None) or [None]:
            want[r["project_id"], u] += 1
    out = M.project_base(projects, ab, heavy_rows=heavy_rows)
    got = defaultdict(int)
    for r in out.collect():
        got[r["project_id"], r["uwid"]] += 1
    assert got == want


def test_hot_allocation_key_is_dealt_out(spark, skew_conf):
    from pyspark.sql import functions as F
    projects, ab = _hot_tables(spark)
    out = M.project_base(projects, ab, heavy_rows=100).where("pink_book_ref = 7")
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 3 and max(sizes) < 0.6 * sum(sizes)


def _objections(spark):
    random.seed(4)
    rows = []
    for i in range(3000):
        project = None if i % 11 == 0 else 5 if i % 3 == 0 else random.randrange(40)
        rows.append((i % 2500, project, "Active" if i % 4 == 0 else None, None,
                     None if i % 7 == 0 else random.randrange(60), random.randrange(9)))
    return rows, spark.createDataFrame(rows, "objection_id long, project_id long, status string, "
                                             "objection_date date, survey_id long, party_id long")


@pytest.mark.parametrize("heavy_rows", [M.HEAVY_ROWS, 200, 0])
def test_objections_of_light_and_heavy_projects(spark, heavy_rows):
    rows, df = _objections(spark)
    want = defaultdict(lambda: [set(), 0, set(), set()])
    for o, p, status, _, survey, party in rows:
        w = want[p]
        w[0].add(o)
        w[1] += status == "Active"
        w[2] |= {survey} - {None}
        w[3].add(party)
    got = M.objection_summary(df, heavy_rows=heavy_rows).collect()
    assert len(got) == len(want)
    for r in got:
        assert [r.objection_count, r.active_objections, r.affected_surveys, r.affected_parties] == \
            [len(w) if isinstance(w, set) else w for w in want[r.project_id]]


def test_objections_are_not_expanded(spark):
    """Light projects' distinct values are counted without four rows an objection; the branch of
    heavy ones has one Expand."""
    _, df = _objections(spark)
    plan = M.objection_summary(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and "collect_set" in plan


def test_few_objections_are_counted_by_project(spark):
    """Heavy projects are found among those whose hash has many objections; the rest is counted by hash only."""
    _, df = _objections(spark)
    plan = M.objection_summary(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "% 65536" in plan or "pmod(xxhash64(project_id" in plan


def test_details_are_shuffled_by_case_only(spark):
    cases = spark.createDataFrame([(i % 30, i % 7, "Active", None, None) for i in range(60)],
                                  "case_id long, project_id long, status string, from_date date, to_date date")
    details = spark.createDataFrame([(i % 40, i % 9 or None, 1.0) for i in range(400)],
                                    "case_id long, survey_id long, area double")
    out = M.court_case_summary(cases, details)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate(keys=[case_id" in plan
    assert not any("HashAggregate(keys=[case_id" in line and "survey_id" in line.split("functions=")[0]
                   for line in plan.splitlines())
    want = defaultdict(set)
    for i in range(60):
        want[i % 7] |= {j % 9 for j in range(400) if j % 40 == i % 30} - {0}
    assert {r.project_id: r.disputed_surveys for r in out.collect()} == {p: len(s) for p, s in want.items()}


def test_projects_are_computed_once_before_their_allocations(spark):
    projects = spark.createDataFrame([(i, None if i % 3 == 0 else i % 5) for i in range(60)],
                                     "project_id long, pink_book_ref long")
    alloc = spark.createDataFrame([(f"u{i}", i % 4) for i in range(30)], "uwid string, PROJECTID long")
    for c in M.ALLOCATION_COLS[2:]:
        alloc = alloc.selectExpr("*", f"'x' AS {c}")
    for heavy_rows in (M.HEAVY_ROWS, 3):
        marked = projects.selectExpr("*", "hash(project_id) AS marked")
        out = M.with_allocations(marked, alloc, heavy_rows)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("AS marked") == 1
        got = sorted((r.project_id, r.uwid or "") for r in out.collect())
        by_key = defaultdict(list)
        for i in range(30):
            by_key[i % 4].append(f"u{i}")
        assert got == sorted((i, u) for i in range(60)
                             for u in ((by_key.get(i % 5) or [""]) if i % 3 else [""]))
