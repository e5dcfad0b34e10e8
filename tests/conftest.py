import pytest

from tessera.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", 4, **{"spark.driver.memory": "3g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
