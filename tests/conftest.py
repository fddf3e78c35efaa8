import pytest

from driftmap.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cpus=4, shuffle_partitions=4)
    yield s
    s.stop()
