import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("BENCH_DRIVER_MEMORY", "8g")
    from barloom.session import local_session

    yield local_session(partitions=4, checkpoint_dir=str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def duck():
    import check

    return check.connect(FOLDER)


FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def folder():
    return FOLDER
