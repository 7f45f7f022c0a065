import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from trialweave.runtime import build_session

    return build_session("4", "trialweave-tests", shuffle_partitions=4)
