import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from freshet.session import local_session

    os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(HERE), os.environ.get("PYTHONPATH", "")])  # for Python workers
    session = local_session(str(tmp_path_factory.mktemp("shared")), "freshet-tests", cores="4", memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
