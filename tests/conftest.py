import pytest
from pyspark.sql import SparkSession


def pytest_addoption(parser):
    parser.addoption("--scores-csv", help="a file of simulated scores with five features and two targets; without it its test is skipped")


@pytest.fixture
def scores_csv(request):
    path = request.config.getoption("--scores-csv")
    if not path:
        pytest.skip("no --scores-csv")
    return path


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
