import pytest

from marginalia.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", cpus=4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
