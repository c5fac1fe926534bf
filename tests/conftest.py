import pytest

from gridloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "8", "8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    import os

    return f"/root/testdata/sf{os.environ.get('TEST_SF', '0.001')}"
