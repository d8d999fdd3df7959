import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from checks.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"
SESSION = local_session(cpus=4, partitions=4)  # test modules build columns while they are imported
# Plans are read whole: a filter list is cut at 100 characters, sooner as column numbers grow.
SESSION.conf.set("spark.sql.maxMetadataStringLength", "2000")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = SESSION
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def column(spark):
    """One-column frame out of plain values, and its results as a list in input order."""

    def make(values, kind="string"):
        return spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")

    return make


def results(df, *expressions):
    rows = df.select("i", *expressions).orderBy("i").collect()
    return [r[1] if len(expressions) == 1 else tuple(r[1:]) for r in rows]
