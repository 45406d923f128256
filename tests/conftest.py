import pytest

from notemill.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8)
    s.conf.set("spark.sql.shuffle.partitions", "2")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
