import pytest

from strandline.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("strandline-tests", cpus=4, **{"spark.driver.memory": "4g"})
    yield s
    s.stop()
