import pytest

from srclens.session import drop_written, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "srclens-tests")
    yield session
    drop_written(session)
