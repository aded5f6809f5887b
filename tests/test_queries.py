"""Every registered reference query against its SQL on DuckDB."""

import duckdb
import pytest

from strataspark.plans import browse, contracts, diffs, extras, facts, mining, reach, services
from strataspark.plans.inputs import TABLES

PLANS = {name: (f, plan.ORACLE[name]) for plan in (browse, mining, reach, diffs, facts, services, contracts, extras) for name, f in plan.QUERIES.items()}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query_equals_sql(spark, sf_dir, duck, name):
    query, sql = PLANS[name]
    ours = query(spark, sf_dir)
    got, want = ours.toPandas().convert_dtypes(), duck.execute(sql).fetch_df().convert_dtypes()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = [sorted(map(tuple, df[cols].astype(str).to_numpy().tolist())) for df in (got, want)]
    assert rows[0] == rows[1]


def test_every_query_has_sql():
    for plan in (browse, mining, reach, diffs, facts, services, contracts, extras):
        assert plan.QUERIES.keys() == plan.ORACLE.keys()
