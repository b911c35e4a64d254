"""The registered queries on whole small tables against their SQL."""

import duckdb
import pytest

from rankloom.llm import queries

TABLES = ("documents", "benchmark", "embeddings", "labels", "pages")


@pytest.fixture(scope="module")
def db(data_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data_dir}/{name}.parquet'")
    return connection


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, data_dir, db, name):
    frame = queries.QUERIES[name](spark, data_dir)
    cursor = db.execute(queries.oracle_sql()[name])
    columns = [column[0] for column in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    assert canonical([tuple(r) for r in frame.collect()], frame.columns) == canonical(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", ["op1_mixing", "op3_sharding", "op7_url_filter", "op9_license_scan"])
def test_native_plans_have_no_python_and_no_cross_join(spark, data_dir, name):
    frame = queries.QUERIES[name](spark, data_dir)
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "simple")
    for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"):
        assert word not in plan


def test_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert "pipeline" not in entry.oracle_sql()
