import pytest

from quillstone.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", shuffle_partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
