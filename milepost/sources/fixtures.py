"""Stand-in source tables derived from the shared test tables.

One order is one project, line number 1..7 is milestone 1..7, a customer is an
allocation and an event is a court case. The view text is plain SQL that runs
unchanged on Spark SQL and on DuckDB; ``{name}`` marks a table reference. On
Spark every reference is bound to a DataFrame (``spark.sql(text, name=df)``), so
no global view names are registered and every view stays a lazy plan over the
parquet scans.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..constants import GAPS
from ..session import bound_tasks, cut_lineage

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events"]

_REF = re.compile(r"\{(\w+)\}")

_JSON_BRACE = re.compile(r'\{(["}])')

# Views in dependency order; each maps to (sql text, referenced tables).
VIEWS: dict[str, str] = {
    "fx_ms": """
SELECT l_orderkey AS project_id, l_linenumber AS k, l_partkey AS survey_id,
 CAST(o_orderdate AS DATE) + CAST((l_linenumber-1)*60 + l_quantity AS INT) AS d
 FROM {lineitem} JOIN {orders} ON l_orderkey=o_orderkey""",
    "AllocationWise": """
WITH b AS (SELECT concat('U',c_custkey) AS uwid, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_custkey END AS PROJECTID, c_name AS ShortNameofWork,
 n_name AS railway, c_mktsegment AS division, concat('A',c_nationkey % 4) AS exec_agency_rly,
 CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN concat(c_nationkey+1,', ',c_nationkey % 7 + 1) ELSE concat(c_nationkey+1,'') END AS states,
 CASE WHEN c_custkey % 23 = 0 THEN 'x,12' ELSE concat(c_custkey % 600 + 1,',',c_custkey % 9 + 1) END AS districts,
 CASE WHEN c_acctbal < 0 THEN 'Pending' ELSE 'Started' END AS land_acq_status
 FROM {customer} JOIN {nation} ON c_nationkey=n_nationkey)
 SELECT * FROM b UNION ALL SELECT * FROM b WHERE PROJECTID % 5 = 0
 UNION ALL SELECT uwid,PROJECTID,ShortNameofWork,railway,'OTHER',exec_agency_rly,states,districts,land_acq_status FROM b WHERE PROJECTID % 10 = 1""",
    "project_basic": """
SELECT o_orderkey AS project_id, concat('P',o_orderkey) AS project_name, o_custkey AS pink_book_ref,
 CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE CAST(o_orderkey * 13 % 100 AS DOUBLE) END AS government_land,
 CAST(o_orderkey * 29 % 150 AS DOUBLE) AS private_land, CAST(o_orderkey * 7 % 40 AS DOUBLE) AS forest_area,
 CASE WHEN o_orderkey % 50 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(o_orderkey*13%100 + o_orderkey*29%150 + o_orderkey*7%40 AS DOUBLE) END AS total_land,
 CAST(o_orderkey % 60 AS DOUBLE) AS land_available, CAST(o_orderkey % 70 AS DOUBLE) AS land_to_be_acquired,
 CAST(o_orderkey % 38 + 1 AS INT) AS state_id, o_orderstatus AS status FROM {orders}""",
    "notification_37A": """
SELECT project_id, CASE WHEN survey_id % 13 = 0 THEN NULL ELSE d END AS publish_date FROM {fx_ms} WHERE k=1""",
    "la_notification_master": """
SELECT project_id, CASE WHEN survey_id % 13 = 0 THEN NULL ELSE d END AS publish_date FROM {fx_ms} WHERE k=2""",
    "three_A_master": """
SELECT project_id, CASE WHEN survey_id % 13 = 0 THEN NULL ELSE d END AS publish_date FROM {fx_ms} WHERE k=3""",
    "three_d_master": """
SELECT project_id, CASE WHEN survey_id % 13 = 0 THEN NULL ELSE d END AS publish_date FROM {fx_ms} WHERE k=4""",
    "nhai_award": """
SELECT project_id*10 + survey_id % 10 AS award_id, project_id, CASE WHEN max(k)>=5 THEN min(CASE WHEN k=5 THEN d END) END AS approval_date FROM {fx_ms} WHERE k>=5 GROUP BY project_id, project_id*10 + survey_id % 10""",
    "nhai_award_det": """
SELECT project_id*10 + survey_id % 10 AS award_id, survey_id, CASE WHEN k=6 THEN d END AS payment_date, CASE WHEN k=7 THEN d END AS mutation_date FROM {fx_ms} WHERE k>=5""",
    "court_case": """
SELECT event_id AS case_id, CAST(floor(event_id/2) AS BIGINT) AS project_id,
 CASE WHEN event_type='error' THEN 'Active' WHEN event_type='view' THEN NULL ELSE 'Closed' END AS status,
 CAST(ts AS DATE) AS from_date, CASE WHEN event_type='purchase' THEN NULL ELSE CAST(ts AS DATE) + CAST(floor(value) AS INT) END AS to_date FROM {events}""",
    "court_case_details": """
SELECT l_orderkey AS case_id, l_partkey AS survey_id, CASE WHEN l_returnflag='N' THEN NULL ELSE l_quantity END AS area FROM {lineitem}""",
    "three_A_objections": """
SELECT l_orderkey*10+l_linenumber AS objection_id, l_orderkey AS project_id,
 CASE WHEN l_linestatus='O' THEN 'Active' ELSE 'Closed' END AS status, CAST(l_shipdate AS DATE) AS objection_date, l_partkey AS survey_id, l_suppkey AS party_id FROM {lineitem}""",
    "project_dates_text": """
SELECT project_id, CASE WHEN project_id % 31 = 0 THEN 'n/a' WHEN project_id % 37 = 0 THEN '31-02-2025'
 ELSE concat(day(d),'-',month(d),'-',year(d)) END AS date_37A FROM {fx_ms} WHERE k=1""",
    "requests": """
SELECT o_orderkey AS request_id,
 CASE WHEN o_custkey % 29 = 0 THEN 'ZZZ' ELSE n_name END AS railway, c_mktsegment AS division,
 CASE o_orderkey % 8 WHEN 0 THEN '37A' WHEN 1 THEN '7A' WHEN 2 THEN '20A' WHEN 3 THEN '20E' WHEN 4 THEN '20F' WHEN 5 THEN '20H' WHEN 6 THEN 'Mutation' ELSE 'XX' END AS current_stage,
 CASE WHEN o_orderkey % 11 = 0 THEN 'bad' ELSE concat(day(o_orderdate),'-',month(o_orderdate),'-',year(o_orderdate)) END AS current_date_text,
 CASE WHEN o_orderkey % 9 = 0 THEN 'x, 7' WHEN o_orderkey % 12 = 0 THEN NULL ELSE concat(o_custkey % 38 + 1,'') END AS states,
 concat(o_orderkey % 600 + 1, ', ', o_orderkey % 9 + 1) AS districts,
 CAST(o_orderkey % 100 AS DOUBLE) AS government_land, CAST(o_orderkey % 3 * 30 AS DOUBLE) AS private_land, CAST(o_orderkey % 5 AS DOUBLE) AS forest_area,
 CAST(o_orderkey % 4 AS INT) AS court_case_count, CAST(o_orderkey % 2 AS INT) AS active_court_cases
 FROM {orders} JOIN {customer} ON o_custkey=c_custkey JOIN {nation} ON c_nationkey=n_nationkey""",
    "request_bodies": """
SELECT o_orderkey AS request_id, CASE o_orderkey % 13
 WHEN 0 THEN 'not json' WHEN 1 THEN '[1,2]' WHEN 2 THEN NULL
 WHEN 3 THEN '{"court_case_count": 1e30}' WHEN 4 THEN '{"court_case_count": "2.9"}'
 WHEN 5 THEN '{"court_case_count": 2.9, "railway": null}' WHEN 6 THEN '{"forest_area": null}'
 WHEN 7 THEN '{"active_court_cases": "NaN", "government_land": "x"}' WHEN 8 THEN '{}'
 WHEN 9 THEN '{"government_land": " 12.5 ", "court_case_count": "7"}'
 WHEN 10 THEN '{"states": null, "division": 5}' WHEN 11 THEN '"text"'
 ELSE concat('{"railway": "R', o_custkey, '", "court_case_count": ', o_custkey, '}') END AS body FROM {orders}""",
    "target_dates": """
SELECT DISTINCT CAST(concat(year(o_orderdate),'-12-31') AS DATE) AS target_date FROM {orders}""",
    "digitalization_records": """
SELECT n_nationkey AS ord, concat(' ',n_name,' ') AS state_ut,
 CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE concat(CAST(floor(n_nationkey * 37 % 1000 / 10) AS INT), '.', n_nationkey * 37 % 10) END AS pct_completed FROM {nation}""",
    "digitalization_repeated": """
SELECT ord, state_ut, pct_completed FROM {digitalization_records}
 UNION ALL SELECT ord + 100, state_ut, '12.5' FROM {digitalization_records} WHERE ord % 4 = 1""",
    "digitalization_malformed": """
SELECT ord, state_ut, pct_completed FROM {digitalization_repeated}
 UNION ALL SELECT ord + 200, state_ut, 'n/a' FROM {digitalization_records} WHERE ord = 7""",
    "state_dim": """
SELECT n_nationkey + 1 AS state_code, CASE WHEN n_nationkey % 8 = 3 THEN NULL ELSE n_name END AS state_name,
 CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE CAST(n_nationkey AS DOUBLE) / 25 END AS fallback_score FROM {nation}""",
}

# A small hand-written ensemble per gap, the same on both engines: (feature, cut, left, right)
# is a split, a number a leaf; "prior" stands for the gap before. Missing features take 42.
FIXED_BASE, FIXED_SCALE, FIXED_MEDIAN = 5.0, 0.5, 42.0
FIXED_TREES = [
    ("government_land", 40.0, 60.0, ("court_case_count", 1.0, 100.0, ("primary_state", 12.0, 130.0, 171.0))),
    ("prior", 63.5, ("forest_proportion", 0.1234, 21.0, 8.0), 55.0),
    ("railway_enc", 9.0, 3.0, ("start_month", 6.0, ("digitalization_score", 0.5, 17.0, 2.5), 30.0)),
]


def fixed_features(k: int) -> list[str]:
    """The features that gap k's fixed ensemble names, in order of appearance."""
    found: list[str] = []

    def visit(t):
        if isinstance(t, tuple):
            found.append(_fixed_name(t[0], k))
            visit(t[2])
            visit(t[3])
    for t in FIXED_TREES:
        visit(t)
    return list(dict.fromkeys(found))


def _fixed_name(feature: str, k: int) -> str:
    if feature != "prior":
        return feature
    return GAPS[k - 1] if k else "private_land"


def fixed_nodes(k: int) -> list[tuple]:
    """Gap k's fixed ensemble as a node table (tree, node, feature, cut, left, right, value)."""
    names, nodes = fixed_features(k), []

    def add(tree: int, t) -> int:
        mine = sum(n[0] == tree for n in nodes)
        nodes.append(None)
        at = len(nodes) - 1
        nodes[at] = (tree, mine, 0, 0.0, mine, mine, 0.0)
        if isinstance(t, tuple):
            left, right = add(tree, t[2]), add(tree, t[3])
            nodes[at] = (tree, mine, names.index(_fixed_name(t[0], k)), t[1], left, right, 0.0)
        else:
            nodes[at] = (tree, mine, 0, 0.0, mine, mine, t)
        return mine
    for i, t in enumerate(FIXED_TREES):
        add(i, t)
    return nodes


def fixed_sql(k: int, value) -> str:
    """Gap k's fixed ensemble as an SQL expression; ``value`` names a feature's SQL."""
    def case(t) -> str:
        if not isinstance(t, tuple):
            return f"CAST({t} AS DOUBLE)"
        return f"CASE WHEN {value(_fixed_name(t[0], k))} <= {t[1]} THEN {case(t[2])} ELSE {case(t[3])} END"
    return f"({FIXED_BASE} + {FIXED_SCALE} * ({' + '.join(case(t) for t in FIXED_TREES)}))"


# The eleven source tables of the master dataset.
SOURCE_TABLES = ["AllocationWise", "project_basic", "notification_37A", "la_notification_master",
                 "three_A_master", "three_d_master", "nhai_award", "nhai_award_det",
                 "court_case", "court_case_details", "three_A_objections"]


def _refs(text: str) -> list[str]:
    return sorted(set(_REF.findall(text)))


def dependencies(names) -> list[str]:
    """Views needed for ``names`` (transitively), in definition order."""
    need: set[str] = set()

    def visit(n):
        if n in VIEWS and n not in need:
            need.add(n)
            for r in _refs(VIEWS[n]):
                visit(r)

    for n in names:
        visit(n)
    return [v for v in VIEWS if v in need]


def with_clause(names) -> str:
    """DuckDB/ANSI ``WITH`` prefix defining the views ``names`` need."""
    parts = []
    for v in dependencies(names):
        body = _REF.sub(r"\1", VIEWS[v].strip())
        parts.append(f"{v} AS ({body})")
    return "WITH " + ",\n".join(parts) + "\n"


class Fixtures:
    """Lazily built fixture DataFrames over one test-data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in VIEWS:
                text = VIEWS[name]
                args = {r: self.table(r) for r in _refs(text)}
                if "{}" in text or '{"' in text:  # braces of JSON text are no references
                    text = _JSON_BRACE.sub(r"{{\1", text).replace("}'", "}}'")
                self._cache[name] = self.spark.sql(text, **args)
            else:
                self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]

    __getitem__ = table

    def sources(self, milestones: bool = True) -> dict[str, DataFrame]:
        """The eleven source tables. With ``milestones`` the join that six of them are views of is
        written once; a query that reads no milestone date leaves that out."""
        if milestones and "fx_ms" not in self._cache:
            bound_tasks(self.spark)
            self._cache["fx_ms"] = cut_lineage(self.table("fx_ms"))
        return {n: self.table(n) for n in SOURCE_TABLES}
