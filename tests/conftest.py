import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from gridspark.session import local_session

    return local_session(cores=4, partitions=4, memory="4g")


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.001"
