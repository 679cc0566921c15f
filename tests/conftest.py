import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tracelat.session import get_spark
    ck = tempfile.mkdtemp(prefix="tracelat-test-ckpt-")
    s = get_spark("local[4]", app="tracelat-tests", shuffle_partitions=8,
                  spark_ui_enabled="false", spark_checkpoint_dir=ck)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_SMALL
