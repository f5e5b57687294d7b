import pytest

from lexalia import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "4", shuffle_partitions=4)
    yield session
    session.stop()
