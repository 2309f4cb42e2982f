import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leadflow.plans.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g", 4)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield session


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def root():
    if not os.path.isdir(DATA):
        pytest.skip("test tables are not here")
    return DATA
