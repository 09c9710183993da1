import pytest

import __spark_entry__
from weftline.jobs import queries as matrix_queries

SF = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_matrix_query_has_sql():
    assert set(matrix_queries.queries()) == set(matrix_queries.oracle_sql())


@pytest.fixture(scope="module")
def sql():
    import duckdb

    connection = duckdb.connect()
    for name in ("lineitem", "orders", "part", "supplier", "customer"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(matrix_queries.queries()))
def test_query_equals_its_sql(spark, sql, name):
    got = matrix_queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    found = sql.execute(f"SELECT {', '.join(columns)} FROM ({matrix_queries.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(tuple(r) for r in found)
