"""Every registered query of the engine against its DuckDB statement."""

import datetime as dt

import duckdb
import pytest

from tessera import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def compared(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, sf_dir, duck, name):
    got = catalog.queries()[name](spark, sf_dir)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert compared(got.columns, got.collect()) == compared(columns, want.fetchall())


def test_flagship_plan(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = catalog.flagship(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "partial_sum" in plan and "Cartesian" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["geo_url", "overlay", "url_between", "url_exclude", "url_exists", "url_filter", "url_not_group", "url_null", "url_or_precedence", "url_regex", "url_search", "url_sets", "url_with"])
def test_no_row_cap(spark, sf_dir, name):
    """Where the statement has no limit, the plan has none."""
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" not in plan and "LocalLimit" not in plan


def test_geo_url_beyond_default(spark):
    """More rows match here than a plain request returns."""
    sql = catalog.oracle_sql()["geo_url"].replace("FROM customer", "FROM '/root/testdata/sf0.1/customer.parquet'")
    assert catalog.queries()["geo_url"](spark, "/root/testdata/sf0.1").count() == len(duckdb.sql(sql).fetchall()) > 1000
