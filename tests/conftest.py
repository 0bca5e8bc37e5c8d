import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tarn.session import local_session

    return local_session("tests", cores=int(os.environ.get("TEST_CPUS", "4")), memory="4g", spark__sql__shuffle__partitions="4")
