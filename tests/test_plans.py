"""Every registered query against its DuckDB SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessella import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted([[_plain(v) for v in r] for r in got.select(*[f"`{c}`" for c in columns]).collect()])
    assert rows == sorted([[_plain(v) for v in r] for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).columns


def test_script_mix_counts_whole_texts(spark, sf_dir):
    """Letters far behind a document's beginning count as well."""
    letters = "length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', ''))"
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(f"sum({letters})").first()[0]
    assert QUERIES["script_mix"](spark, sf_dir).selectExpr("sum(latin)").first()[0] >= whole
