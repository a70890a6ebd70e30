import pytest

from siftwell.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", "tests", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
