import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from postloom.session import local_session, use_shared_folder  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    use_shared_folder(str(tmp_path_factory.mktemp("shared")))
    return local_session("postloom-tests", "8", shuffle_partitions=4)


@pytest.fixture(scope="session")
def data():
    return os.environ.get("POSTLOOM_TEST_DATA", "/root/testdata/sf0.001")
