import pytest

from tideline.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="4", app="tests", shuffle=4, memory="4g")
    yield s
    s.stop()
