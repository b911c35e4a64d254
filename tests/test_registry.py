"""Every registered query against its SQL, and the shape of the plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from rankloom.plans.oracle import SQL
from rankloom.plans.registry import QUERIES

TABLES = ("documents", "benchmark", "embeddings", "labels", "events", "pages", "conversations")
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def db(data_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data_dir}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def frame_of(spark, data_dir):
    """Each query is planned once; planning one can run jobs."""
    made = {}

    def build(name):
        if name not in made:
            made[name] = QUERIES[name](spark, data_dir)
        return made[name]

    return build


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def test_every_query_has_its_sql():
    assert QUERIES.keys() == SQL.keys()
    assert QUERIES.keys() <= entry.queries().keys() and SQL.keys() <= entry.oracle_sql().keys()


@pytest.mark.parametrize("name", NAMES)
def test_agrees_with_sql(frame_of, db, name):
    frame = frame_of(name)
    cursor = db.execute(SQL[name])
    columns = [column[0] for column in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    rows = [tuple(row) for row in frame.collect()]
    assert rows, "an empty result proves nothing"
    assert canonical(rows, frame.columns) == canonical(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", NAMES)
def test_plan_has_no_cross_join(spark, frame_of, name):
    frame = frame_of(name)
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "simple")
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_entry(spark, data_dir):
    rows = entry.entry(spark).collect()
    assert len(rows) == 16 and {r.method for r in rows} == {"bm25"}
