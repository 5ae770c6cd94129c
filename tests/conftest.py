import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from checks.compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session(4)


@pytest.fixture(scope="session")
def people(spark):
    """Four rows, the last two alike but for their place in the order."""
    rows = [(1, "31", "Lyon", 1), (2, None, "Lyon", 2), (3, "47", None, 3), (3, "47", None, 4)]
    return spark.createDataFrame(rows, "id int, age string, city string, at int")


def values(df, *columns):
    """Rows of a small frame as plain tuples, in order."""
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
