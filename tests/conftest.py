import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from chartspark.session import local_session, tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = tune(local_session("4", shuffle_partitions=4, memory="4g"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
