"""Every registered query with an oracle equals its DuckDB SQL on the small tables."""

import os

import duckdb
import pytest

from conftest import SF_SMALL

import __spark_entry__ as E
from milepost.plans import oracles, queries
from tools.oracle_check import TABLES, rows

ORACLES = oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_is_registered():
    q = queries.queries()
    assert set(ORACLES) <= set(q) <= set(E.queries())
    # the learned-model queries are rows-only
    assert set(q) - set(ORACLES) == {"gap_model_report", "forecast_learned",
                                     "snapshot_learned", "score_requests_learned"}


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    sc, sr = rows(sdf.toPandas())
    dc, dr = rows(con.execute(ORACLES[name]).fetchdf())
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr
    # same column types on both engines
    rel = con.sql(ORACLES[name])
    duck = dict(zip(rel.columns, [str(t) for t in rel.types]))
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in sdf.schema.fields}
    assert spark_types == duck


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"target_date", "stage", "projects_reached", "percentage"} <= set(df.columns)
