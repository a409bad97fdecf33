import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from orrery.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="orrery-tests",
                      checkpoint=tempfile.mkdtemp(prefix="orrery-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture
def tmpdir_path():
    return tempfile.mkdtemp(prefix="orrery-test-")


@pytest.fixture
def feed(spark, tmpdir_path):
    from tests.feed import build_feed

    return build_feed(spark, tmpdir_path)
