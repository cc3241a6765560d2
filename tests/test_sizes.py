"""What a task holds and what is moved at scale: sizes of tasks, joins that are made once, work that is left out."""

from pyspark.sql import functions as F

from milepost.constants import STAGE_COLS
from milepost.operators import master as M
from milepost.session import START_PARTITIONS, TASK_SIZES, bound_tasks, drop_tables
from milepost.sources.fixtures import Fixtures

SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
START = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

TABLES = {
    "orders": "select 1L o_orderkey, 7L o_custkey, 'O' o_orderstatus, timestamp '2024-01-01' o_orderdate",
    "lineitem": """select 1L l_orderkey, k l_linenumber, 5L + k l_partkey, 2L l_suppkey, 1D l_quantity, 'A' l_returnflag,
     'O' l_linestatus, timestamp '2024-02-01' l_shipdate from (select explode(sequence(1, 7)) k)""",
    "customer": "select 7L c_custkey, 'c' c_name, 1 c_nationkey, 1D c_acctbal, 'm' c_mktsegment",
    "nation": "select 1 n_nationkey, 'n' n_name",
    "events": "select 2L event_id, timestamp '2024-03-01' ts, 'error' event_type, 1D value",
}


def made(spark, path) -> Fixtures:
    for name, text in TABLES.items():
        spark.sql(text).write.parquet(f"{path}/{name}.parquet")
    return Fixtures(spark, str(path))


def test_task_sizes_are_set_only_where_the_session_says_nothing(spark):
    plain, own = spark.newSession(), spark.newSession()
    for s in (plain, own):
        for key in [*TASK_SIZES, START]:
            s.conf.unset(key)
    own.conf.set(SIZE, "8m")
    own.conf.set("spark.sql.shuffle.partitions", "2000")
    for s in (plain, own):
        bound_tasks(s)
    assert plain.conf.get(SIZE) == TASK_SIZES[SIZE] and own.conf.get(SIZE) == "8m"
    assert int(plain.conf.get(START)) == START_PARTITIONS and int(own.conf.get(START)) == 2000


def test_a_master_bounds_its_tasks(spark, tmp_path):
    src = made(spark, tmp_path).sources()
    for build in (M.master_dataset, M.milestone_rows):
        spark.conf.unset(START)
        build(src)
        assert int(spark.conf.get(START)) >= START_PARTITIONS
    drop_tables(spark)


def test_the_feeds_share_one_join(spark, tmp_path):
    """Six sources are views of one join; it is made once, not once a feed, and gives the same dates."""
    src = made(spark, tmp_path).sources()
    found = M.milestone_dates(src)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan
    lazy = Fixtures(spark, str(tmp_path))
    assert found.collect() == M.milestone_dates({n: lazy[n] for n in src}).collect()
    assert None not in found.first()
    drop_tables(spark)


def test_a_query_without_dates_makes_no_milestone_join(spark, tmp_path):
    fx = made(spark, tmp_path)
    M.master_dataset(fx.sources(milestones=False)).select("railway", "division").collect()
    assert drop_tables(spark) == 0


def test_dates_alone_read_no_objection(spark, tmp_path):
    src = dict(made(spark, tmp_path).sources())
    src["three_A_objections"] = src["three_A_objections"].withColumn(
        "project_id", F.raise_error(F.lit("read")).cast("bigint"))
    assert M.master_dataset(src).select("project_id", *STAGE_COLS).count() == 1
    drop_tables(spark)
