import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from spanloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(8, "6g", 4)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


RANGES = "seqname string, range_start long, range_end long"


@pytest.fixture
def ranges(spark):
    """ranges([(seqname, start, end, ...)], "more ddl") -> DataFrame"""
    return lambda rows, more="": spark.createDataFrame([tuple(r) for r in rows], RANGES + (", " + more if more else ""))


@pytest.fixture
def rows():
    """Sorted list of tuples of a DataFrame."""
    key = lambda t: tuple((x is None, str(type(x)) if x is None else "", x if x is not None else 0) for x in t)
    return lambda df, *cols: sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=key)
