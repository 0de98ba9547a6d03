import pytest

from trapline.session import build_session, release

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def inputs(spark):
    from trapline.plans.inputs import Inputs
    return Inputs(spark, SMALL)
