import pytest

from cotejo.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "cotejo-tests")
    yield session
    session.stop()
