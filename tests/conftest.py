import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from feedmerge.session import build_session

    ckpt = tempfile.mkdtemp(prefix="feedmerge-test-ckpt-")
    s = build_session("local[4]", app_name="feedmerge-tests", shuffle_partitions=4,
                      **{"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path(tmp_path):
    return str(tmp_path)
