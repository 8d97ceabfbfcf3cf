import pytest

from tracewarp.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, 8, "6g")
    s.sparkContext.setLogLevel("ERROR")
    return s
