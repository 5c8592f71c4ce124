import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from rosterlab.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("rosterlab-tests", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def split(spark):
    """Force the route for oversized keys on tiny frames."""
    spark.conf.set("rosterlab.groupBytes", "1")
    spark.conf.set("rosterlab.groupRows", "40")
    yield
    spark.conf.unset("rosterlab.groupBytes")
    spark.conf.unset("rosterlab.groupRows")


def rows(df, *cols):
    out = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in out.collect()), key=str)
