import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from plexmat.session import find_package, local_session

    s = local_session(os.environ.get("TEST_CPUS", "4"), 4)
    s.sparkContext.setLogLevel("ERROR")
    find_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
