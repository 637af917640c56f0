"""Registered queries against their SQL on the smallest tables, and what registration promises."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
import pytest

from tidepanel.queries import oracle_sql, queries

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
# too few dates for windows of 200 rows and more at this scale are fine: the engines must still agree
NAMES = sorted(oracle_sql())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return con


def settled(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype == bool or str(df[c].dtype) == "boolean":
            df[c] = df[c].astype(object)
        if df[c].dtype == object or str(df[c].dtype).startswith(("datetime", "str")):
            df[c] = df[c].map(lambda v: None if pd.isna(v) else str(v)[:10] if hasattr(v, "year") else str(v))
        else:
            df[c] = df[c].astype(float).round(4) + 0.0
    keys = [c for c in df if df[c].dtype == object] + [c for c in df if df[c].dtype != object]
    return df.sort_values(keys).reset_index(drop=True)


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    got, want = queries()[name](spark, str(DATA)).toPandas(), duck.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(settled(got), settled(want), check_dtype=False, atol=1e-3)


@needs_data
@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_runs(spark, name):
    """What has no SQL has a test of its own operator; here: rows come, each with its key, and some figures (at this scale not all)."""
    got = queries()[name](spark, str(DATA)).toPandas()
    assert len(got) and got.iloc[:, 0].notna().all() and got.notna().to_numpy().mean() > 0.5


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@needs_data
def test_plans_prune_scans_and_shuffle_once_by_entity(spark):
    from tidepanel.plans.features import returns

    plan = returns(spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "struct<l_partkey:bigint,l_quantity:double,l_extendedprice:double,l_shipdate" in plan and "l_comment" not in plan
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Sort [") == 1 and "Python" not in plan
