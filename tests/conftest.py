import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from clauselake.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="clauselake-tests")
    yield s


SF_SMALL = "/root/testdata/sf0.001"
