import pytest

from pagelake.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s
