import pytest

from faultline.session import Scratch, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, app="faultline-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def scratch(spark):
    return Scratch(spark, "test")
