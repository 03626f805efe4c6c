import pytest

from tokenloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
