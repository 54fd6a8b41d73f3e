import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from redline.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=8, app="redline-tests",
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="redline-test-ckpt-", dir="/tmp")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF_SMALL
