import pytest

from archlens import registry, session

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    spark = session.local_session("8", 8)
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
