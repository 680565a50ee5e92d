"""Every registered query against its SQL, and the others for rows alone."""

import duckdb
import pytest

from tidemark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events embeddings labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


def cells(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = cells(catalog.queries()[name](spark, sf).toPandas())
    assert got == cells(duck.execute(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, sf, name):
    made = catalog.queries()[name](spark, sf)
    assert list(made.toPandas().columns) == made.columns


def test_no_nested_loop_joins(spark, sf):
    for name in ("in_intervals", "sync", "ccg_counts", "intersect", "match_closest", "psth"):
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_scan_reads_only_what_it_needs(spark, sf):
    plan = catalog.queries()["match_up"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)" in plan
