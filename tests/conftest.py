import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lectern.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session(8, 4)


@pytest.fixture(scope="session")
def tables(spark):
    from lectern.plans.fixtures import Tables
    return Tables(spark, SMALL)
