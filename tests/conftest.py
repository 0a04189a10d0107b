from __future__ import annotations

import os
import tempfile

import pytest

from codelake.session import session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    own = session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-")})
    yield own
    own.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA
