import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from rankloom.session import local_session  # noqa: E402

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def data_dir():
    if not DATA.exists():
        pytest.skip("test tables are not here")
    return str(DATA)


@pytest.fixture(scope="session")
def make_run(spark):
    """A run from ``{qid: [doc_id, ...]}``, best first."""

    def build(lists, schema="qid string, doc_id string, score double, rank int"):
        rows = [
            (qid, doc, float(len(docs) - place), place + 1)
            for qid, docs in lists.items()
            for place, doc in enumerate(docs)
        ]
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def make_qrels(spark):
    def build(sets):
        rows = [(qid, doc) for qid, docs in sets.items() for doc in docs]
        return spark.createDataFrame(rows, "qid string, doc_id string")

    return build
