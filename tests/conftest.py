import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quarry.session import checkpoint_dir, get_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("quarry-tests", master="local[4]", shuffle_partitions=4)
    checkpoint_dir(s)
    yield s
