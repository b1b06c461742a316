import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from herdlens.session import local_session

    s = local_session("*", shuffle_partitions=8, app="herdlens-tests")
    # Tests set their own shared folder (on a cluster it comes from the session).
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="herdlens-test-ckpt-"))
    yield s
    s.stop()
