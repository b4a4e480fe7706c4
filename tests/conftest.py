import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from market_rows import NOW  # noqa: E402
from stallbook.config import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("8", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return session


@pytest.fixture(scope="session")
def now():
    return NOW


class Tables:
    """Hand-made rows with the declared schemas; columns left out are NULL."""

    def __init__(self, spark):
        self.spark = spark

    def __call__(self, name, rows):
        from stallbook.schemas import schema

        fields = schema(name)
        for f in fields.fields:
            f.nullable = True
        return self.spark.createDataFrame(
            [tuple(r.get(f.name) for f in fields.fields) for r in rows], fields)

    def rows(self, ddl, rows):
        return self.spark.createDataFrame(rows, ddl)


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark)
