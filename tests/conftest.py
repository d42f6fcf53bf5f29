import os
import sys

import pytest

os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--conf spark.ui.showConsoleProgress=false pyspark-shell")
sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from framewright.session import local_session

    session = local_session(4, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    from compare import DATA

    place = os.path.join(DATA, "sf0.001")
    if not os.path.isdir(place):
        pytest.skip("no test data here")
    return place
